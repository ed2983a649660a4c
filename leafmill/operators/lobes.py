"""Lines and the lobes of an outline: dealing lines to lobes, and cutting an outline at its necks.

All of a shape (its ring and its lines) is in one row, so a cut is a projection; the only shuffle
is the gathering of a page's lines before it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from leafmill.functions import lobearrays as la
from leafmill.functions import polygons as pg

#: A line goes to a lobe that it lies in, or not farther than this outside of.
REACH = 15
#: Shapes under this area, points, lines are never cut; a lobe needs this area and share of the whole.
LEAST_AREA, LEAST_POINTS, LEAST_LINES, LOBE_AREA, LOBE_SHARE = 3500, 10, 2, 1200, 0.10
#: Deepest defects that are paired, and the most a neck may take of the smaller side.
MOST_DEFECTS, WIDEST_NECK = 12, 0.95


def middle(line: Column) -> tuple[Column, Column]:
    """The centre of a line box in whole numbers."""
    return F.floor((line["x0"] + line["x1"]) / 2), F.floor((line["y0"] + line["y1"]) / 2)


def lines_to_lobes(lines: DataFrame, lobes: DataFrame, reach: int = REACH) -> DataFrame:
    """Each line of ``lines`` (page_id, seq, box) with the lobe of ``lobes`` (page_id, lobe, ring) of
    the largest signed distance, ties to the smaller lobe, if that is at least -``reach``.

    Lobe and distance are null for lines that no lobe reaches. Only pages meet pages."""
    x, y = middle(F.struct("x0", "y0", "x1", "y1"))
    # Spark takes a ring for a few bytes, so it must not choose to broadcast them
    held = lobes.select("page_id", "lobe", "ring").hint("merge")
    met = lines.join(held, "page_id", "left").withColumn("far", pg.squares(F.col("ring"), x, y))
    best = met.groupBy("page_id", "seq").agg(F.max(F.struct("far", (-F.col("lobe")).alias("lobe"))).alias("best"))
    near = F.col("best.far") >= -(reach * reach)
    far = F.col("best.far")
    return best.select("page_id", "seq", F.when(near, -F.col("best.lobe")).alias("lobe"), F.when(near, F.signum(far) * F.sqrt(F.abs(far)) + 0.0).alias("distance"))


def _lobe(ring: Column, i: Column, j: Column) -> tuple[Column, Column]:
    """The two rings that the chord between places i < j leaves."""
    return F.slice(ring, i + 1, j - i + 1), F.concat(F.slice(ring, j + 1, F.size(ring) - j), F.slice(ring, 1, i + 1))


def _cuts(deep: float):
    """A function of (ring, lines, where): the places (i, j) of the ends of the neck, whether the lobe
    between them comes first, and the lobe (0, 1) of each line; null without a neck. All outlines of a
    batch are looked at together."""

    @arrow_udf("i int, j int, ahead boolean, side array<int>")
    def find(rings: pa.Array, lines: pa.Array, where: pa.Array) -> pa.Array:
        on = where.fill_null(False).to_numpy(zero_copy_only=False)
        least = la.Least(LEAST_AREA, LEAST_POINTS, LEAST_LINES, LOBE_AREA, LOBE_SHARE)
        i, j, ahead, side = la.cuts(rings, lines, on, deep, MOST_DEFECTS, least, WIDEST_NECK, REACH)
        offsets = np.append(0, np.cumsum(lines.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
        sides = pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), pa.array(side.astype("int32")))
        return pa.StructArray.from_arrays([pa.array(i.astype("int32")), pa.array(j.astype("int32")), pa.array(ahead > 0), sides], ["i", "j", "ahead", "side"], mask=pa.array(i < 0))

    return find


def cut_at_neck(shapes: DataFrame, where: Column, glyph: float = 25.0, depth: float = 18.0) -> DataFrame:
    """``shapes`` (..., ring, lines) with ``pieces``: two (ring, lines), or null without a neck or
    where ``where`` is false.

    A neck is the shortest valid chord between two deep bends of the outline: not too wide, across
    the way the lines are arranged, inside the outline, not through text, with two lobes of some
    size. Lines go to the lobe they lie in or are nearest to; if that leaves a lobe without a
    line, they are dealt in halves along the arrangement. Ties go to the deeper bends."""
    ring, lines = F.col("ring"), F.col("lines")
    boxes = F.transform(lines, lambda s: F.struct(*[s[c].cast("int").alias(c) for c in ("seq", "x0", "y0", "x1", "y1")]))
    out = shapes.withColumn("neck", _cuts(max(8.0, min(depth, glyph * 0.45)))(ring.cast(pg.RINGS), boxes, where))
    one, two = _lobe(ring, F.col("neck.i"), F.col("neck.j"))
    mine = lambda to: F.filter(lines, lambda s, k: F.get(F.col("neck.side"), k) == to)
    piece = lambda r, to: F.struct(r.alias("ring"), _in_order(mine(to)).alias("lines"))
    upper, lower = F.when(F.col("neck.ahead"), one).otherwise(two), F.when(F.col("neck.ahead"), two).otherwise(one)
    pieces = F.when(F.col("neck").isNotNull(), F.array(piece(upper, 0), piece(lower, 1)))
    return out.withColumn("pieces", pieces).drop("neck")


def _in_order(lines: Column) -> Column:
    """Lines from top to bottom, then left to right."""
    keyed = F.transform(lines, lambda s: F.struct(s["y0"].alias("y"), s["x0"].alias("x"), s["seq"].alias("seq"), s.alias("line")))
    return F.transform(F.array_sort(keyed), lambda k: k["line"])


def split_lobes(shapes: DataFrame, turns: int = 2) -> DataFrame:
    """``shapes`` (key..., ring, lines: array of (seq, x0, y0, x1, y1)) cut into lobes.

    Returns the key columns, ring, lines and lobe ("1", or "1.2.1" after two cuts). A lobe that was
    cut off and has four lines or more is looked at again, ``turns`` times in all."""
    keys = [c for c in shapes.columns if c not in ("ring", "lines")]
    rows = shapes.withColumns({"lobe": F.lit("1"), "again": F.lit(True)})
    for _ in range(turns):
        cut = cut_at_neck(rows, F.col("again"))
        parts = F.coalesce("pieces", F.array(F.struct("ring", "lines")))
        cut = cut.select(*keys, "lobe", F.col("pieces").isNotNull().alias("was_cut"), F.posexplode(parts).alias("k", "piece"))
        path = F.when(F.col("was_cut"), F.concat("lobe", F.lit("."), (F.col("k") + 1).cast("string"))).otherwise(F.col("lobe"))
        rows = cut.select(*keys, "piece.ring", "piece.lines", path.alias("lobe"), (F.col("was_cut") & (F.size("piece.lines") >= 4)).alias("again"))
    return rows.drop("again")
