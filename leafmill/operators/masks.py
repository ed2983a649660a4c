"""Masks as runs: rows (key..., row, s, e), one for each maximal run s <= x < e of a row.

Set operations sweep over the ends of runs, row by row; connected parts are found by union-find
over the runs of neighbouring rows; growth from seeds is a choice among connected parts. Masks of
any number of shapes go through one plan, dealt by key and row, and no pixel is ever a row.

Where a page's shapes fit into its row (``by_page``), runs are made and used up in a task, for many
pages at once (``functions/maskarrays``): only the shapes are sent, by page, and nothing is written.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import maskarrays as ma
from leafmill.functions import polygons as pg
from leafmill.functions import ringarrays as ra
from leafmill.operators.grouped import Rows, grouped
from leafmill.sources.working import discard, settled

#: Sizes, in cells, under which a part of a cut is dust, and a hole is closed.
DUST_CELLS, DUST_SHARE, HOLE_CELLS = 120, 0.04, 1500


def from_rings(shapes: DataFrame, key: list[str], height: int) -> DataFrame:
    """The runs of the cells whose middles lie in ``ring`` (array<array<double>>), in rows 0 to ``height``.

    The runs of a ring are found in its row, for all rings of a batch at once."""
    return joined(shapes.select(*key, F.inline(pg.runs(F.col("ring"), height))), key)


def from_boxes(boxes: DataFrame, key: list[str]) -> DataFrame:
    """The runs of boxes (key..., x0, y0, x1, y1), ends excluded; overlapping ones become one mask."""
    rows = F.when(F.col("y1") > F.col("y0"), F.sequence(F.col("y0"), F.col("y1") - 1))
    return joined(boxes.where("x1 > x0").select(*key, F.explode(rows).alias("row"), F.col("x0").alias("s"), F.col("x1").alias("e")), key)


def joined(runs: DataFrame, key: list[str]) -> DataFrame:
    """Any runs as maximal ones: those that meet or touch become one."""
    order = Window.partitionBy(*key, "row").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    x = runs.withColumn("new", F.coalesce((F.col("s") > before).cast("int"), F.lit(1)))
    x = x.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*key, "row", "part").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("part")


def swept(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Both masks as pieces (key..., row, s, e, ina, inb) that lie wholly in or out of each.

    Each run opens at its start and closes at its end; between two ends next to each other a cell
    is in a mask if more of its runs were opened than closed. One sweep a row, over both masks."""
    cols = [*key, "row"]

    def ends(runs: DataFrame, mine: int) -> DataFrame:
        step = lambda v: [F.lit(v if mine == k else 0).alias(f"d{k}") for k in (0, 1)]
        return runs.select(*cols, F.col("s").alias("x"), *step(1)).unionAll(runs.select(*cols, F.col("e").alias("x"), *step(-1)))

    steps = ends(a, 0).unionAll(ends(b, 1)).groupBy(*cols, "x").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    order = Window.partitionBy(*cols).orderBy("x")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    inside = steps.select(*cols, F.col("x").alias("s"), F.lead("x").over(order).alias("e"), (F.sum("d0").over(upto) > 0).alias("ina"), (F.sum("d1").over(upto) > 0).alias("inb"))
    return inside.where("e is not null and (ina or inb)")


def combined(a: DataFrame, b: DataFrame, key: list[str], keep: Callable[[Column, Column], Column]) -> DataFrame:
    """The runs of the cells of either mask for which ``keep`` (is in a, is in b) holds."""
    return joined(swept(a, b, key).where(keep(F.col("ina"), F.col("inb"))).drop("ina", "inb"), key)


def both(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return combined(a, b, key, lambda x, y: x & y)


def without(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return combined(a, b, key, lambda x, y: x & ~y)


def either(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return combined(a, b, key, lambda x, y: x | y)


def grown(runs: DataFrame, key: list[str], by: int = 1) -> DataFrame:
    """A mask and all cells within ``by`` steps (left, right, up or down) of it."""
    spread = runs.select(*key, "row", "s", "e", F.explode(F.sequence(F.lit(-by), F.lit(by))).alias("d"))
    side = by - F.abs("d")
    return joined(spread.select(*key, (F.col("row") + F.col("d")).alias("row"), (F.col("s") - side).alias("s"), (F.col("e") + side).alias("e")), key)


def sizes(runs: DataFrame, key: list[str]) -> DataFrame:
    """Cells, runs and box of each mask."""
    return runs.groupBy(*key).agg(F.sum(F.col("e") - F.col("s")).alias("cells"), F.count("*").alias("runs"), F.min("s").alias("x0"), F.min("row").alias("y0"), F.max("e").alias("x1"), (F.max("row") + 1).alias("y1"))


def _labels(key: list[str], reach: int):
    """Union-find over the runs of a mask: each run meets those of the row before that it touches."""

    def each(rows: Rows) -> Rows:
        row, s, e = rows["row"], rows["s"], rows["e"]
        parent = list(range(len(row)))

        def root(v: int) -> int:
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        above, here, start = range(0), 0, 0
        for i in range(1, len(row) + 1):
            if i < len(row) and row[i] == row[start]:
                continue
            if len(above) and row[above[0]] == row[start] - 1:
                j = above[0]
                for k in range(start, i):
                    while j < above.stop and e[j] + reach <= s[k]:
                        j += 1
                    here = j
                    while here < above.stop and s[here] < e[k] + reach:
                        a, b = root(here), root(k)
                        parent[max(a, b)] = min(a, b)
                        here += 1
            above, start = range(start, i), i
        return {**rows, "part": [root(v) for v in range(len(row))]}

    return each


def parts(runs: DataFrame, key: list[str], corners: bool = True) -> DataFrame:
    """``runs`` with ``part``, a number for each connected part of a mask, in reading order of first runs.

    With ``corners``, cells that meet at a corner are connected (8 neighbours), else not (4)."""
    types = dict(runs.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in key), "row int, s int, e int, part int"])
    plain = runs.select(*key, *[F.col(c).cast("int") for c in ("row", "s", "e")])
    return grouped(plain, key, ["row", "s"], _labels(key, 1 if corners else 0), schema)


def holding(runs: DataFrame, points: DataFrame, key: list[str]) -> DataFrame:
    """``points`` (key..., x, y, ...) that lie on ``runs``, with the other columns of these."""
    r, p = runs.alias("r"), points.alias("p")
    same = (F.col("r.row") == F.col("p.y")) & (F.col("r.s") <= F.col("p.x")) & (F.col("p.x") < F.col("r.e"))
    for k in key:
        same = same & (F.col(f"r.{k}") == F.col(f"p.{k}"))
    return p.join(r, same).select("p.*", *[F.col(f"r.{c}") for c in runs.columns if c not in points.columns])


def reached(field: DataFrame, seeds: DataFrame, key: list[str]) -> DataFrame:
    """The cells of ``field`` that can be walked to from ``seeds`` (key..., x, y), in four directions.

    That is what a frontier comes to that goes on from row to row until nothing is new: the
    connected parts of the field that hold a seed."""
    labelled = parts(field, key, corners=False)
    hit = holding(labelled, seeds.select(*key, "x", "y"), key).select(*key, "part").distinct()
    return labelled.join(hit, [*key, "part"], "left_semi").drop("part")


def holes(runs: DataFrame, key: list[str], most: int = HOLE_CELLS) -> DataFrame:
    """The runs of what a mask encloses, for holes of under ``most`` cells."""
    size = sizes(runs, key)
    frame = from_boxes(size.select(*key, (F.col("x0") - 1).alias("x0"), (F.col("y0") - 1).alias("y0"), (F.col("x1") + 1).alias("x1"), (F.col("y1") + 1).alias("y1")), key)
    outside = settled(parts(without(frame, runs, key), key, corners=False), "outside")
    inner = sizes(outside, [*key, "part"]).alias("h").join(size.alias("m"), key)
    within = (F.col("h.x0") >= F.col("m.x0")) & (F.col("h.y0") >= F.col("m.y0")) & (F.col("h.x1") <= F.col("m.x1")) & (F.col("h.y1") <= F.col("m.y1"))
    kept = inner.where(within & (F.col("h.cells") < most)).select(*key, "part")
    out = settled(outside.join(kept, [*key, "part"], "left_semi").drop("part"), "holes")
    discard(outside)
    return out


def grow_selection(mask: DataFrame, field: DataFrame, barrier: DataFrame, seeds: DataFrame, key: list[str], near: int = 5) -> DataFrame:
    """``mask`` and what it grows to over ``field`` from ``seeds``, without crossing ``barrier``.

    Of what the seeds reach, parts are added that lie within ``near`` steps of the mask; small holes
    close, but never over the barrier."""
    mask, barrier = settled(mask, "mask"), settled(barrier, "barrier")
    free = settled(without(field, barrier, key), "free")
    new = settled(parts(without(reached(free, seeds, key), mask, key), key), "new")
    close = grown(mask, key, near)
    touching = new.alias("n").join(close.alias("c"), [F.col(f"n.{k}") == F.col(f"c.{k}") for k in [*key, "row"]]).where("n.s < c.e and c.s < n.e").select(*[F.col(f"n.{k}") for k in key], "n.part").distinct()
    merged = settled(either(mask, new.join(touching, [*key, "part"], "left_semi").drop("part"), key), "merged")
    inside = holes(merged, key)
    out = settled(either(merged, without(inside, barrier, key), key), "selection")
    discard(mask, barrier, free, new, merged, inside)
    return out


def scissors(mask: DataFrame, stroke: DataFrame, lines: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cut ``mask`` along ``stroke`` and deal ``lines`` (key..., seq, x, y) to the two sides.

    Returns a verdict a mask (key..., n_parts, verdict) and the lines of the masks cut in two
    (key..., seq, side: 1, 2, or null where it is in both or neither). What is under DUST_CELLS or
    DUST_SHARE of the mask is no part. Both sides get the seam back, a step wide; they are in
    reading order, by rows of 40 cells."""
    mask = settled(mask, "mask")
    whole = sizes(mask, key).select(*key, F.col("cells").alias("whole"))
    cut = settled(parts(without(mask, stroke, key), key), "cut")
    large = sizes(cut, [*key, "part"]).join(whole, key).where(F.col("cells") >= F.greatest(F.lit(DUST_CELLS), F.floor(F.col("whole") * DUST_SHARE)))
    counted = whole.join(large.groupBy(*key).agg(F.count("*").alias("n")), key, "left")
    n = F.coalesce("n", F.lit(0))
    verdict = F.when(F.col("whole") < 50, "too small").when(n < 2, "not through").when(n > 2, "too many").otherwise("cut")
    verdicts = settled(counted.select(*key, n.alias("n_parts"), verdict.alias("verdict")), "verdicts")
    order = Window.partitionBy(*key).orderBy(F.floor(F.col("y0") / 40), "x0", "part")
    sides = large.withColumn("side", F.row_number().over(order)).join(verdicts.where("verdict = 'cut'"), key).select(*key, "part", "side")
    one = cut.join(sides, [*key, "part"]).drop("part")
    wide = grown(one, [*key, "side"])
    back = both(wide, mask.join(sides.select(*key, "side"), key), [*key, "side"])
    held = holding(back, lines, key).groupBy(*key, "seq").agg(F.count("*").alias("n"), F.min("side").alias("side"))
    asked = lines.join(verdicts.where("verdict = 'cut'").select(*key), key, "left_semi")
    dealt = settled(asked.join(held, [*key, "seq"], "left").select(*key, "seq", F.when(F.col("n") == 1, F.col("side")).alias("side")), "dealt")
    discard(mask, cut)
    return verdicts, dealt


#: Pages whose runs are held at once.
PAGES = 1000


def shapes_of(df: DataFrame, key: list[str], shape: Column, name: str) -> DataFrame:
    """The shapes of ``df`` (rings, or structs of a box and what belongs to it) as a list a key.

    What a shape is made of is sent, not the shape, unless the rows lie by key already."""
    return df.repartition(*key).groupBy(*key).agg(F.collect_list(shape).alias(name))


class Page:
    """The shapes of some rows that came from ``shapes_of``, with ``group`` the number of the row."""

    def __init__(self, rows: pa.RecordBatch):
        self.rows, self.n = rows, rows.num_rows

    def _flat(self, name: str) -> tuple[np.ndarray, pa.Array]:
        lists = self.rows.column(name)
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return np.repeat(np.arange(self.n), sizes), lists.flatten()

    def rings(self, name: str, height: int, scale: int) -> ma.Runs:
        """The mask of each row's rings, their points divided by ``scale``, in rows 0 to ``height``."""
        group, rings = self._flat(name)
        r = ra.Rings(rings)
        r.x, r.y = r.x / scale, r.y / scale
        ring, row, s, e = ra.runs(r, height)
        return ma.joined(ma.Runs(group[ring], row, s, e))

    def fields(self, name: str, *names: str) -> tuple[np.ndarray, ...]:
        """The group of each struct of a list, and its fields as whole numbers; what has a null is left out."""
        group, flat = self._flat(name)
        whole = np.ones(len(flat), bool)
        for c in names:
            whole &= flat.field(c).is_valid().to_numpy(zero_copy_only=False)
        kept = [flat.field(c).filter(pa.array(whole)).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
        return group[whole], *kept


def by_page(pages: DataFrame, key: list[str], each: Callable[[Page], dict], schema: str) -> DataFrame:
    """``each`` of the pages of a task, some at once, as columns; its ``group`` tells whose key a row gets."""
    types = dict(pages.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in key), schema])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                rows = batch.slice(at, PAGES)
                out = each(Page(rows))
                group = pa.array(out.pop("group"))
                named = {k: rows.column(k).take(group) for k in key} | out
                yield pa.RecordBatch.from_arrays([pa.array(v) if not isinstance(v, pa.Array) else v for v in named.values()], schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))
    return pages.mapInArrow(run, schema)
