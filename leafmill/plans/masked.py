"""Queries over masks: outlines and text boxes in cells of 10 pixels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from leafmill.functions import maskarrays as ma
from leafmill.operators import masks as mk
from leafmill.plans import outlines as ol
from leafmill.plans.registry import register
from leafmill.sources.tables import view

KEY, HEIGHT = ["page_id"], 45


def _outlines(spark, sf):
    return mk.shapes_of(view(spark, sf, "outlines_v"), KEY, ol.outline_ring(), "rings").hint("merge")


def _lines(spark, sf, *more):
    """The lines of each page, their boxes in cells; ``lines_v`` has them by page."""
    cell = lambda c: F.floor(F.col(c) / 10).cast("int").alias(c)
    x = view(spark, sf, "lines_v").groupBy("page_id")
    return x.agg(F.collect_list(F.struct(*[cell(c) for c in ("x0", "y0", "x1", "y1")], *more)).alias("lines")).hint("merge")


def _of(page):
    """Outlines and texts of pages."""
    return page.rings("rings", HEIGHT, 10), ma.boxes(*page.fields("lines", "x0", "y0", "x1", "y1"))


def _sizes(runs):
    found = ma.sizes(runs)._asdict()
    return found | {c: found[c].astype(np.int32) for c in ("x0", "y0", "x1", "y1")}


SIZES = "cells long, runs long, x0 int, y0 int, x1 int, y1 int"
OPS = {"both": lambda a, b: a & b, "outline_only": lambda a, b: a & ~b, "either": lambda a, b: a | b}


# cells of both masks: a cell is inside if the row's middle line crosses an odd number of edges left of its middle
CELLS = f"""rings AS (SELECT page_id, {ol.ring_sql()} AS ring FROM outlines_v),
edge AS (SELECT page_id, CAST(ring[i][1] AS DOUBLE) / 10 AS ax, CAST(ring[i][2] AS DOUBLE) / 10 AS ay, CAST(ring[i % len(ring) + 1][1] AS DOUBLE) / 10 AS ux, CAST(ring[i % len(ring) + 1][2] AS DOUBLE) / 10 AS uy FROM (SELECT *, unnest(range(1, len(ring) + 1)) AS i FROM rings)),
hits AS (SELECT page_id, y, ax + (y + 0.5 - ay) * (ux - ax) / (uy - ay) AS x FROM (SELECT *, unnest(range({HEIGHT})) AS y FROM edge) WHERE (ay > y + 0.5) <> (uy > y + 0.5)),
spans AS (SELECT page_id, y, x AS lo, lead(x) OVER w AS hi, row_number() OVER w AS k FROM hits WINDOW w AS (PARTITION BY page_id, y ORDER BY x)),
a AS (SELECT DISTINCT page_id, y, unnest(range(CAST(greatest(0, ceil(lo - 0.5)) AS INT), CAST(greatest(0, ceil(hi - 0.5)) AS INT))) AS x FROM spans WHERE k % 2 = 1),
b AS (SELECT DISTINCT page_id, y, unnest(range(x0 // 10, x1 // 10)) AS x FROM (SELECT page_id, x0, x1, unnest(range(y0 // 10, y1 // 10)) AS y FROM lines_v))"""


@register(f"""WITH {CELLS}, j AS (SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.y, b.y) AS y, coalesce(a.x, b.x) AS x, a.x IS NOT NULL AS ina, b.x IS NOT NULL AS inb FROM a FULL JOIN b ON a.page_id = b.page_id AND a.y = b.y AND a.x = b.x),
o AS (SELECT page_id, y, x, unnest(['both', 'outline_only', 'either']) AS op, unnest([ina AND inb, ina AND NOT inb, true]) AS held FROM j),
g AS (SELECT page_id, op, y, x, x - row_number() OVER (PARTITION BY page_id, op, y ORDER BY x) AS island FROM o WHERE held)
SELECT page_id, op, count(*) AS cells, count(DISTINCT (y, island)) AS runs, CAST(min(x) AS INT) AS x0, CAST(min(y) AS INT) AS y0, CAST(max(x) + 1 AS INT) AS x1, CAST(max(y) + 1 AS INT) AS y1 FROM g GROUP BY page_id, op""")
def mask_operations(spark, sf):
    """And, and-not and or of each page's outline and its text, from runs."""
    pages = _outlines(spark, sf).join(_lines(spark, sf), "page_id", "full")

    def each(page):
        pieces, ina, inb = ma.swept(*_of(page))
        found = {op: _sizes(ma.joined(pieces.at(keep(ina, inb)))) for op, keep in OPS.items()}
        out = {c: np.concatenate([x[c] for x in found.values()]) for c in found["both"]}
        return {"group": out.pop("group"), "op": np.repeat(list(found), [len(x["group"]) for x in found.values()])} | out

    return mk.by_page(pages, KEY, each, f"op string, {SIZES}")


def _seed():
    """The cell right above the middle of each page's first line."""
    first = F.col("seq") == 1
    return F.when(first, F.floor((F.col("x0") + F.col("x1")) / 20).cast("int")).alias("x"), F.when(first, (F.floor(F.col("y0") / 10) - 1).cast("int")).alias("y")


def _seeds(page):
    return ma.points(*page.fields("lines", "x", "y"))


@register(f"""WITH RECURSIVE {CELLS}, f AS (SELECT page_id, y, x, x - row_number() OVER (PARTITION BY page_id, y ORDER BY x) AS island FROM a ANTI JOIN b USING (page_id, y, x)),
r AS MATERIALIZED (SELECT page_id, y, min(x) AS s, max(x) + 1 AS e FROM f GROUP BY page_id, y, island),
z AS (SELECT page_id, (x0 + x1) // 20 AS x, y0 // 10 - 1 AS y FROM lines_v WHERE seq = 1),
w AS (SELECT r.page_id, r.y, r.s, r.e FROM r JOIN z ON z.page_id = r.page_id AND z.y = r.y AND z.x >= r.s AND z.x < r.e
  UNION SELECT r.page_id, r.y, r.s, r.e FROM w JOIN r ON r.page_id = w.page_id AND (r.y = w.y - 1 OR r.y = w.y + 1) AND r.s < w.e AND w.s < r.e)
SELECT page_id, CAST(sum(e - s) AS BIGINT) AS cells, count(*) AS runs FROM w GROUP BY page_id""")
def region_reached(spark, sf):
    """What a seed above the first line reaches inside of the outline without crossing text."""
    pages = _lines(spark, sf, *_seed()).join(_outlines(spark, sf), "page_id")

    def each(page):
        outlines, texts = _of(page)
        found = _sizes(ma.reached(ma.without(outlines, texts), _seeds(page)))
        return {c: found[c] for c in ("group", "cells", "runs")}

    return mk.by_page(pages, KEY, each, "cells long, runs long")


@register()
def selection_grown(spark, sf):
    """The text masks, grown from the seeds over the outline up to the caption rectangle's border."""
    rects = view(spark, sf, "rects_v").select("page_id", *[F.floor(F.col(c) / 10).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")])
    side = [("x0", "y0", "x1", "y0 + 1"), ("x0", "y1 - 1", "x1", "y1"), ("x0", "y0", "x0 + 1", "y1"), ("x1 - 1", "y0", "x1", "y1")]
    border = F.inline(F.array(*[F.struct(*[F.expr(v).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), box)]) for box in side]))
    rects = rects.repartition("page_id").select("page_id", border)
    borders = mk.shapes_of(rects, KEY, F.struct("x0", "y0", "x1", "y1"), "borders").hint("merge")
    pages = _lines(spark, sf, *_seed()).join(_outlines(spark, sf), "page_id", "left").join(borders, "page_id", "left")

    def each(page):
        outlines, texts = _of(page)
        barrier = ma.boxes(*page.fields("borders", "x0", "y0", "x1", "y1"))
        return _sizes(ma.grow_selection(texts, outlines, barrier, _seeds(page), mk.HOLE_CELLS))

    return mk.by_page(pages, KEY, each, SIZES)


@register()
def scissors_cut(spark, sf):
    """Outlines cut by a stroke along the first line of the page, as far as that line goes."""
    cell = lambda c: F.floor(c / 10).cast("int")
    wide = F.when(F.col("page_id") % 2 == 0, F.lit(900)).otherwise(F.lit(0))  # on every other page the stroke goes all through
    stroke = F.when(F.col("seq") == 1, F.struct(cell(F.col("x0") - wide).alias("s"), cell(F.col("x1") + wide).alias("e"), cell(F.col("y0")).alias("row")))
    # a line without a place lies on no mask, but is dealt
    middle = [F.coalesce(F.floor((F.col(f"{c}0") + F.col(f"{c}1")) / 20).cast("int"), F.lit(-1000)).alias(c) for c in "xy"]
    pages = _outlines(spark, sf).join(_lines(spark, sf, "seq", *middle, *[stroke[c].alias(c) for c in ("s", "e", "row")]), "page_id", "left")

    def each(page):
        outlines = page.rings("rings", HEIGHT, 10)
        group, s, e, row = page.fields("lines", "s", "e", "row")
        of, seq, x, y = page.fields("lines", "seq", "x", "y")
        masks, cells, n, side = ma.scissors(outlines, ma.boxes(group, s, row, e, row + 1), ma.points(of, x, y), mk.DUST_CELLS, mk.DUST_SHARE)
        verdict = np.select([cells < 50, n < 2, n > 2], ["too small", "not through", "too many"], "cut")
        place = np.full(page.n, -1)
        place[masks[verdict == "cut"]] = np.flatnonzero(verdict == "cut")
        told = [[[] for _ in masks] for _ in range(3)]  # in both or neither, on the first side, on the second
        for at, k, v in sorted(zip(place[of].tolist(), side.tolist(), seq.tolist())):
            if at >= 0:
                told[k][at].append(str(v))
        some = [any(v) for v in zip(*told)]
        seqs = {c: pa.array([" ".join(v) if on else None for v, on in zip(told[k], some)], pa.string()) for c, k in (("first", 1), ("second", 2), ("ambiguous", 0))}
        return {"group": masks, "n_parts": n, "verdict": verdict} | seqs

    return mk.by_page(pages, KEY, each, "n_parts long, verdict string, first string, second string, ambiguous string")
