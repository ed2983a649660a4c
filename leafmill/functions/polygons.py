"""Column builders for polygons: rings of points as array<array<number>>, without a closing point.

Simple sums are folds over the edges of a ring, which may stand inside lambdas; hulls, bends and
corners are found for all rings of an Arrow batch at once. Distances are kept squared until the end,
so that with whole coordinates what is compared is exact but for one division. Each builder takes
columns, so the rings stay in their rows and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from leafmill.functions import ringarrays as ra


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row, however often they are used later."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def ring_of(*points: tuple[Column, Column]) -> Column:
    return F.array(*[F.array(x, y) for x, y in points])


def edges(ring: Column, of: Callable[[Column, Column], Column]) -> Column:
    """``of`` each point and the one after it."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), of)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def signed_area2(ring: Column) -> Column:
    """Twice the area; its sign tells the direction of the ring."""
    return _total(edges(ring, lambda a, b: a[0] * b[1] - b[0] * a[1]))


def area(ring: Column) -> Column:
    return F.abs(signed_area2(ring)) / 2


def perimeter(ring: Column) -> Column:
    return _total(edges(ring, lambda a, b: F.sqrt((b[0] - a[0]) * (b[0] - a[0]) + (b[1] - a[1]) * (b[1] - a[1]))))


def box(ring: Column) -> Column:
    """(x0, y0, x1, y1) around a ring."""
    xs, ys = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def signed_square(ring: Column, x: Column, y: Column) -> Column:
    """The squared distance of (x, y) to the border of a ring, negative outside of it."""

    def edge(a: Column, b: Column) -> Column:
        dx, dy, px, py = b[0] - a[0], b[1] - a[1], x - a[0], y - a[1]
        along, length, side = px * dx + py * dy, dx * dx + dy * dy, dx * py - dy * px
        ends = F.least(px * px + py * py, (x - b[0]) * (x - b[0]) + (y - b[1]) * (y - b[1]))
        near = F.when((length > 0) & (along >= 0) & (along <= length), (side * side) / length).otherwise(ends)
        crosses = ((a[1] > y) != (b[1] > y)) & F.when(b[1] > a[1], side > 0).otherwise(side < 0)
        return F.struct(near.cast("double").alias("d"), crosses.alias("c"))

    start = F.struct(F.lit(float("inf")).alias("d"), F.lit(False).alias("odd"))
    step = lambda s, e: F.struct(F.least(s["d"], e["d"]).alias("d"), (s["odd"] != e["c"]).alias("odd"))
    return F.aggregate(edges(ring, edge), start, step, lambda s: F.when(s["odd"], s["d"]).otherwise(-s["d"]))


def signed_distance(ring: Column, x: Column, y: Column) -> Column:
    """The distance of (x, y) to the border of a ring, negative outside of it."""
    return let(signed_square(ring, x, y), lambda d: F.signum(d) * F.sqrt(F.abs(d)))


RINGS = "array<array<double>>"
_struct = lambda **kinds: T.StructType([T.StructField(k, v) for k, v in kinds.items()])
REAL, WHOLE = T.DoubleType(), T.IntegerType()


@arrow_udf(T.ArrayType(_struct(x=REAL, y=REAL, i=WHOLE)))
def _hulls(rings: pa.Array) -> pa.Array:
    r = ra.Rings(rings)
    ring, place = ra.hull_places(r)
    x, y = r.point(ring, place)
    return ra.lists(r, ring, pa.StructArray.from_arrays([pa.array(x), pa.array(y), pa.array(place.astype("int32"))], ["x", "y", "i"]))


@arrow_udf(T.ArrayType(_struct(depth=REAL, far=WHOLE)))
def _defects(rings: pa.Array) -> pa.Array:
    r = ra.Rings(rings)
    ring, depth, far = ra.bends(r)
    return ra.lists(r, ring, pa.StructArray.from_arrays([pa.array(depth), pa.array(far.astype("int32"))], ["depth", "far"]))


@arrow_udf(T.ArrayType(WHOLE))
def _simplified(rings: pa.Array, tolerances: pa.Array) -> pa.Array:
    r = ra.Rings(rings)
    ring, place = ra.kept_places(r, tolerances.to_numpy(zero_copy_only=False))
    return ra.lists(r, ring, pa.array(place.astype("int32")))


@arrow_udf(_struct(area=REAL, perimeter=REAL, hull_area=REAL, corners=WHOLE))
def _measures(rings: pa.Array, shares: pa.Array) -> pa.Array:
    r = ra.Rings(rings)
    around = ra.perimeters(r)
    ring, _ = ra.kept_places(r, around * shares.to_numpy(zero_copy_only=False))
    found = [abs(ra.areas2(r)) / 2, around, ra.hull_areas(r), np.bincount(ring, minlength=len(r)).astype("int32")]
    return pa.StructArray.from_arrays([pa.array(v) for v in found], ["area", "perimeter", "hull_area", "corners"], mask=r.nulls())


@arrow_udf(REAL)
def _signed_squares(rings: pa.Array, xs: pa.Array, ys: pa.Array) -> pa.Array:
    r = ra.Rings(rings)
    x, y = (v.to_numpy(zero_copy_only=False) for v in (xs, ys))
    return pa.array(ra.signed_squares(r, x, y), mask=~r.whole | ~np.isfinite(x + y))


@arrow_udf(T.ArrayType(_struct(row=WHOLE, s=WHOLE, e=WHOLE)))
def _runs(rings: pa.Array, heights: pa.Array) -> pa.Array:
    r = ra.Rings(rings)
    ring, *found = ra.runs(r, heights[0].as_py() if len(heights) else 0)
    return ra.lists(r, ring, pa.StructArray.from_arrays([pa.array(v.astype("int32")) for v in found], ["row", "s", "e"]))


def runs(ring: Column, height: int) -> Column:
    """The runs (row, s, e) of the cells in rows 0 to ``height`` whose middles lie in a ring."""
    return _runs(ring.cast(RINGS), F.lit(height))


def measures(ring: Column, share: float = 0.02) -> Column:
    """(area, perimeter, hull_area, corners at a tolerance of ``share`` of the perimeter) of a ring, in one pass.

    Like ``hull``, ``defects``, ``simplified`` and ``squares`` for whole columns only, not inside lambdas."""
    return _measures(ring.cast(RINGS), F.lit(share))


def squares(ring: Column, x: Column, y: Column) -> Column:
    """``signed_square`` for whole columns: all rings of a batch at once."""
    return _signed_squares(ring.cast(RINGS), x.cast("double"), y.cast("double"))


def hull(ring: Column) -> Column:
    """The convex hull by monotone chains: structs (x, y, i) with i the place in the ring.

    Points on its sides are left out; fewer than three points in general position give a hull
    without area."""
    return _hulls(ring.cast(RINGS))


def points_of(indexed: Column) -> Column:
    return F.transform(indexed, lambda p: F.array(p["x"], p["y"]))


def solidity(ring: Column) -> Column:
    """The share of a ring's area in that of its convex hull; 1 without a hull area."""
    return let(measures(ring), lambda m: F.when(m["hull_area"] > 0, m["area"] / m["hull_area"]).otherwise(F.lit(1.0)))


def defects(ring: Column) -> Column:
    """Where a ring bends in from its hull: (depth, far) for each side of the hull with points under
    it, far being the place of the deepest one."""
    return _defects(ring.cast(RINGS))


def simplified(ring: Column, tolerance: Column) -> Column:
    """The places of the points that Douglas and Peucker's rule keeps of a closed ring.

    The ring is cut at the point farthest from its first one and at the point farthest from that."""
    return _simplified(ring.cast(RINGS), tolerance.cast("double"))


def corners(ring: Column, share: float = 0.02) -> Column:
    """How many corners a ring has at a tolerance of ``share`` of its perimeter."""
    return measures(ring, share)["corners"]


def plain_rectangle(ring: Column) -> Column:
    """Whether a ring fills its box (94 %) with at most five corners."""
    filled = let(box(ring), lambda b: area(ring) / F.greatest(F.lit(1.0), ((b["x1"] - b["x0"]) * (b["y1"] - b["y0"])).cast("double")))
    return (filled >= 0.94) & (corners(ring) <= 5)
