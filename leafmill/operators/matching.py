"""Spatial joins: claims, nearest in a band, coverage, best match, seams, neighbours, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.geometry import Box, colour_distance
from leafmill.operators.grouped import Rows, grouped


BAND = 64


def _in_bands(items: DataFrame, top: Column, bottom: Column) -> DataFrame:
    return items.withColumn("band", F.explode(F.sequence(F.floor(top / BAND), F.floor(F.greatest(top, bottom) / BAND))))


def _beside(lines: DataFrame, rects: DataFrame, reach: int = 0) -> DataFrame:
    """Lines and rectangles (r_...) of a page that overlap in height, or lie at most ``reach`` apart.

    Both are dealt to horizontal bands of their page, so that a crowded page is not met all with
    all; a pair is kept in its first common band. Rectangles lie by band in one row a page, and
    bands of lines are made where their page is: each line is sent at most once, by its page."""
    sides = ("rect_idx", "x0", "y0", "x1", "y1")
    r = rects.select("page_id", F.struct(*[F.col(c).alias(c if c == "rect_idx" else f"r_{c}") for c in sides]).alias("r")).repartition("page_id")
    r = _in_bands(r, F.col("r.r_y0"), F.col("r.r_y1")).groupBy("page_id", "band").agg(F.collect_list("r").alias("rs"))
    r = r.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("band", "rs"))).alias("rects"))
    met = _in_bands(lines.join(r, "page_id"), F.col("y0") - reach, F.col("y1") + reach).withColumn("r", F.explode(F.try_element_at("rects", F.col("band"))))
    top = F.floor((F.col("y0") - reach) / BAND)
    return met.where(F.col("band") == F.greatest(top, F.floor(F.col("r.r_y0") / BAND))).drop("band", "rects").select("*", "r.*").drop("r")


def claim_lines(lines: DataFrame, rects: DataFrame, least: float = 0.5) -> DataFrame:
    """(page_id, seq, rect_idx): the first rectangle that holds at least half of the line."""
    line, rect = Box.of(), Box.of("r_")
    held = _beside(lines, rects).where(line.intersection(rect) >= least * F.greatest(F.lit(1), line.area))
    return held.groupBy("page_id", "seq").agg(F.min("rect_idx").alias("rect_idx"))


def nearest_rect(lines: DataFrame, rects: DataFrame, band: int = 40) -> DataFrame:
    """For lines without a claim: the nearest rectangle at most ``band`` away, the first of equals."""
    line, rect = Box.of(), Box.of("r_")
    square = F.pow(line.gap_x(rect), 2) + F.pow(line.gap_y(rect), 2)
    # what holds half of a line overlaps it, so claims are among the pairs within the band
    claim = F.coalesce(line.intersection(rect) >= 0.5 * F.greatest(F.lit(1), line.area), F.lit(False))
    met = _beside(lines, rects, band).select("page_id", "seq", "rect_idx", claim.alias("claim"), square.cast("long").alias("square"))
    nearest = F.min(F.when(F.col("square") <= band * band, F.struct("square", "rect_idx")))
    near = met.groupBy("page_id", "seq").agg(nearest.alias("m"), F.max("claim").alias("claimed")).where("m is not null and not claimed")
    return near.select("page_id", "seq", F.col("m.rect_idx").alias("rect_idx"), F.col("m.square").alias("square_distance"))


def uncovered(rects: DataFrame, lines: DataFrame, least: float = 0.35) -> DataFrame:
    """Rectangles of which no line covers ``least``."""
    line, rect = Box.of(), Box.of("r_")
    covered = _beside(lines, rects).where(line.intersection(rect) >= least * F.greatest(F.lit(1), rect.area)).select("page_id", "rect_idx").distinct()
    return rects.join(covered, ["page_id", "rect_idx"], "left_anti")


def adjacent(lines: DataFrame, gap: int = 35, overlap: float = 0.35) -> DataFrame:
    """Lines that have a neighbour: close in one direction, overlapping in the other."""
    b = lines.select("page_id", *[F.col(c).alias(f"b_{c}") for c in ("seq", "x0", "y0", "x1", "y1")])
    a, o = Box.of(), Box.of("b_")
    part = lambda lo, hi, size, other: F.greatest(F.lit(0), hi - lo) >= overlap * F.greatest(F.lit(1), F.least(size, other))
    h = part(F.greatest(a.x0, o.x0), F.least(a.x1, o.x1), a.width, o.width)
    v = part(F.greatest(a.y0, o.y0), F.least(a.y1, o.y1), a.height, o.height)
    near = ((a.gap_y(o) <= gap) & h) | ((a.gap_x(o) <= gap) & v)
    met = _in_bands(lines, a.y0 - gap, a.y1 + gap).join(_in_bands(b, o.y0, o.y1), ["page_id", "band"])
    return met.where((F.col("seq") != F.col("b_seq")) & near).select("page_id", "seq").distinct()


def best_match(boxes: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each box (page_id, rect_idx, ...) its best candidate line: by overlap, else by proximity.

    Scores are whole numbers (millionths), so that they do not depend on rounding; ties go to the
    smaller seq. ``phase`` tells which rule matched."""
    c, g = Box.of(), Box.of("r_")
    met = _beside(candidates, boxes, 100)  # the farthest gap that proximity allows
    inter = c.intersection(g)
    ca, ga = F.greatest(F.lit(1), c.area), F.greatest(F.lit(1), g.area)
    milli = lambda top, bottom: F.floor(1_000_000 * top.cast("long") / bottom).cast("long")
    met = met.withColumns({"inter": inter, "iou": milli(inter, ca + ga - inter), "of_c": milli(inter, ca), "of_g": milli(inter, ga), "ratio": milli(F.least(ca, ga), F.greatest(ca, ga))})
    met = met.withColumn("dx", milli(F.abs(g.x0 + g.x1 - c.x0 - c.x1), 2 * F.greatest(F.lit(1), g.width, c.width))).withColumn("dy", milli(F.abs(g.y0 + g.y1 - c.y0 - c.y1), 2 * F.greatest(F.lit(1), g.height, c.height)))
    enough = (F.col("iou") >= 400_000) | (F.col("of_c") >= 350_000) | (F.col("of_g") >= 350_000)
    direct = (F.col("inter") > 0) & enough & (F.col("dx") < 400_000) & (F.col("dy") < F.when(F.col("dx") < 200_000, 500_000).otherwise(350_000))
    score = F.expr("5 * iou + 3 * of_c + 2 * of_g + 2 * ratio - dx - dy")
    wide = milli(F.greatest(F.lit(0), F.least(c.x1, g.x1) - F.greatest(c.x0, g.x0)), F.greatest(F.lit(1), F.least(c.width, g.width)))
    met = met.withColumn("wide", wide).withColumn("v_gap", c.gap_y(g))
    close = (F.col("wide") >= 500_000) & (F.col("v_gap") <= 100) & (F.col("ratio") >= 250_000)
    near = F.expr("2 * wide - 20000 * v_gap")
    pick = lambda cond, value: F.max(F.when(cond, F.struct(value.alias("score"), (-F.col("seq")).alias("neg"))))
    out = met.groupBy("page_id", "rect_idx").agg(pick(direct & (score > -2_000_000), score).alias("a"), pick(close & (near > -1_000_000), near).alias("b"))
    phase = F.when(F.col("a").isNotNull(), 1).when(F.col("b").isNotNull(), 2)
    return out.where("a is not null or b is not null").select("page_id", "rect_idx", (-F.coalesce("a.neg", "b.neg")).alias("seq"), F.coalesce("a.score", "b.score").cast("long").alias("score"), phase.alias("phase"))


def seam_dedupe(first: DataFrame, second: DataFrame, dx: int = 25, dy: int = 18) -> DataFrame:
    """Both tiles' items, without those of the second whose centre is near one of the first."""
    a = first.select("page_id", *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")])
    middle = F.floor((F.col("a_y0") + F.col("a_y1")) / 2)
    a = _in_bands(a, middle - dy, middle + dy).alias("a")  # where the centre of a copy may lie
    b = second.withColumn("band", F.floor(F.floor((F.col("y0") + F.col("y1")) / 2) / BAND)).alias("b")
    close = (F.abs(F.col("a_x0") + F.col("a_x1") - F.col("b.x0") - F.col("b.x1")) < 2 * dx) & (F.abs(F.col("a_y0") + F.col("a_y1") - F.col("b.y0") - F.col("b.y1")) < 2 * dy)
    same = (F.col("b.page_id") == F.col("a.page_id")) & (F.col("b.band") == F.col("a.band"))
    return first.unionByName(b.join(a, same & close, "left_anti").drop("band"))


#: Signatures that are held together, and those that stand for the cells around them where there are more.
BLOCK_SIGNATURES, PIVOTS = 4096, 64


def _with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """``df`` with the columns of a table of one row."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(row.withColumn("_one", F.lit(1))), "_one").drop("_one")


def _nearest(v: str, known: str):
    """(d, name) of the nearest of an array of (name, s), ties to the smaller name."""
    return F.array_min(F.transform(known, lambda k: F.struct(colour_distance(F.col(v), k["s"]).alias("d"), k["name"].alias("name"))))


def nearest_signature(queries: DataFrame, signatures: DataFrame, most: float = 160.0, least: float = 0.5) -> DataFrame:
    """The signature nearest to each query colour vector, and its confidence; below ``least`` none.

    Up to BLOCK_SIGNATURES of ``signatures`` (name, v), all are held by each task. More are dealt to
    cells around PIVOTS of them: a query's distance to its nearest pivot bounds that to the nearest
    signature, and by the triangle inequality only cells whose nearest member can be as close are
    looked at, in blocks of bounded size."""
    n = signatures.count()
    pair = F.struct("name", F.col("v").alias("s"))
    if n <= BLOCK_SIGNATURES:
        best = _with_row(queries, signatures.agg(F.array_sort(F.collect_list(pair)).alias("known"))).select("id", _nearest("v", "known").alias("m")).select("id", "m.*")
    else:
        some = signatures.orderBy(F.xxhash64("name"), "name").limit(PIVOTS).agg(F.array_sort(F.collect_list(pair)).alias("pivots"))
        placed = _with_row(signatures, some).withColumn("m", _nearest("v", "pivots")).select("name", "v", F.col("m.name").alias("cell"), F.col("m.d").alias("d"))
        block = F.pmod(F.xxhash64("name"), F.lit(-(-n // BLOCK_SIGNATURES)))
        blocks = placed.groupBy("cell", block.alias("block")).agg(F.array_sort(F.collect_list(pair)).alias("known")).drop("block")
        reach = placed.groupBy("cell").agg(F.max("d").alias("reach")).agg(F.map_from_entries(F.collect_list(F.struct("cell", "reach"))).alias("reach"))  # an entry a pivot
        x = _with_row(_with_row(queries, some), reach)
        far = F.transform("pivots", lambda k: F.struct(k["name"].alias("cell"), colour_distance(F.col("v"), k["s"]).alias("d")))
        x = x.withColumn("far", far).withColumn("bound", F.array_min(F.transform("far", lambda f: f["d"])))
        # a little slack, as distances are rounded
        open_cells = F.filter("far", lambda f: f["d"] - F.element_at("reach", f["cell"]) <= F.col("bound") * (1 + 1e-9) + 1e-9)
        x = x.select("id", "v", F.explode(F.transform(open_cells, lambda f: f["cell"])).alias("cell")).join(blocks, "cell").select("id", _nearest("v", "known").alias("m"))
        best = x.groupBy("id").agg(F.min("m").alias("m")).select("id", "m.*")
    conf = F.greatest(F.lit(0.0), 1 - F.col("d") / most)
    return best.select("id", F.when(conf >= least, F.col("name")).alias("name"), conf.alias("conf"))


def suppress(boxes: DataFrame, iou: float = 0.40, contained: float = 0.65) -> DataFrame:
    """Greedy suppression of duplicate boxes of a page (page_id, seq, box, score, text_key).

    In the order of score, a box goes if it overlaps one already kept, unless both have texts
    that differ and neither lies almost wholly in the other. Adds ``kept``. Order decides, so
    each page is one group of its (few) boxes."""

    def greedy(rows: Rows) -> Rows:
        kept, flags = [], []
        for x0, y0, x1, y1, key in zip(rows["x0"], rows["y0"], rows["x1"], rows["y1"], rows["text_key"]):
            area, clash = max(1, (x1 - x0) * (y1 - y0)), False
            for a0, b0, a1, b1, other, size in kept:
                inter = max(0, min(x1, a1) - max(x0, a0)) * max(0, min(y1, b1) - max(y0, b0))
                if inter and (inter / (area + size - inter) >= iou or inter / area >= contained or inter / size >= contained):
                    if not (key and other and key != other and inter / area < 0.88 and inter / size < 0.88):
                        clash = True
                        break
            flags.append(not clash)
            if not clash:
                kept.append((x0, y0, x1, y1, key, area))
        return {"page_id": rows["page_id"], "seq": rows["seq"], "kept": flags}

    slim = boxes.select("page_id", "seq", "x0", "y0", "x1", "y1", (-F.col("score")).alias("low"), "text_key")
    return grouped(slim, ["page_id"], ["low", "seq"], greedy, "page_id long, seq int, kept boolean")


def outer_panels(boxes: DataFrame, covered: int = 75) -> DataFrame:
    """The boxes of a page (page_id, seq, box) with ``kept``: from the largest down, those of which no
    kept one covers over ``covered`` percent. Equal sizes go by seq.

    A fold over a page's sorted boxes, in the row that holds them."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    rows = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct((-area).alias("low"), "seq", "x0", "y0", "x1", "y1"))).alias("all"))

    def over(a, b):
        w, h = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
        return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0)) * 100 > -b["low"] * covered

    kept = F.aggregate("all", F.slice("all", 1, 0), lambda held, b: F.when(F.exists(held, lambda a: over(a, b)), held).otherwise(F.array_append(held, b)))
    rows = rows.select("page_id", "all", F.transform(kept, lambda b: b["seq"]).alias("kept"))
    return rows.select("page_id", F.explode("all").alias("b"), "kept").select("page_id", "b.seq", F.array_contains("kept", F.col("b.seq")).alias("kept"))


def merge_envelopes(boxes: DataFrame, iou: float = 0.4) -> DataFrame:
    """Second-pass boxes (pass = 2) widen the first box that they overlap, else are added.

    The target grows, so order decides; a page is one group. Returns page_id, x0, y0, x1, y1."""

    def merge(rows: Rows) -> Rows:
        out: list[list[int]] = []
        for turn, x0, y0, x1, y1 in zip(rows["pass"], rows["x0"], rows["y0"], rows["x1"], rows["y1"]):
            for o in out if turn == 2 else ():
                inter = max(0, min(x1, o[2]) - max(x0, o[0])) * max(0, min(y1, o[3]) - max(y0, o[1]))
                if inter / max(1, (x1 - x0) * (y1 - y0) + (o[2] - o[0]) * (o[3] - o[1]) - inter) > iou:
                    o[:] = [min(o[0], x0), min(o[1], y0), max(o[2], x1), max(o[3], y1)]
                    break
            else:
                out.append([x0, y0, x1, y1])
        out.sort(key=lambda b: (b[1] // 80, b[0]))
        return {"page_id": rows["page_id"][:1] * len(out)} | {c: [b[i] for b in out] for i, c in enumerate(("x0", "y0", "x1", "y1"))}

    return grouped(boxes.select("page_id", "seq", "pass", "x0", "y0", "x1", "y1"), ["page_id"], ["pass", "seq"], merge, "page_id long, x0 int, y0 int, x1 int, y1 int")
