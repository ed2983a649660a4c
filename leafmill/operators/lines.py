"""Line pairs, clusters of lines and their splits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import clusterarrays as ca
from leafmill.functions.geometry import Box
from leafmill.operators.grouped import Rows, grouped

MAX_DX, MAX_DY, CENTER_TOLERANCE, BAND = 30, 40, 0.65, 64


def line_pairs(lines: DataFrame, max_dx: int = MAX_DX, max_dy: int = MAX_DY, tolerance: float = CENTER_TOLERANCE, band: int = BAND) -> DataFrame:
    """Pairs of lines of a page that may belong together.

    Lines meet in horizontal bands, so a crowded page is not compared all with all; a pair is
    kept in the band where its later line starts. Returns page_id, a_seq, b_seq, gap_x, gap_y,
    c_dist2 (twice the distance of the centres) and diamond (joined across a gap by centring)."""
    bands = F.sequence(F.floor(F.col("y0") / band), F.floor((F.col("y1") + max_dy) / band))
    spread = lines.select("page_id", "seq", "x0", "y0", "x1", "y1", F.explode(bands).alias("band"))
    named = lambda p: spread.select("page_id", "band", *[F.col(c).alias(p + c) for c in ("seq", "x0", "y0", "x1", "y1")])
    a, b = Box.of("a_"), Box.of("b_")
    met = named("a_").join(named("b_"), ["page_id", "band"]).where("a_seq < b_seq").where(F.floor(F.greatest("a_y0", "b_y0") / band) == F.col("band"))
    met = met.withColumns({"gap_x": a.gap_x(b), "gap_y": a.gap_y(b), "c_dist2": F.abs(a.x0 + a.x1 - b.x0 - b.x1), "wider": F.greatest(a.width, b.width)})
    met = met.withColumn("centred", F.col("c_dist2") <= F.greatest(F.col("wider") * tolerance, F.lit(2.0 * max_dx)))
    near = (F.col("gap_x") <= min(max_dx, 12)) & ~((F.col("gap_x") > 15) & (F.col("gap_y") > 15))
    kept = met.where((F.col("gap_y") <= max_dy) & (F.col("centred") | near))
    return kept.select("page_id", "a_seq", "b_seq", "gap_x", "gap_y", "c_dist2", (F.col("centred") & (F.col("gap_x") > 0)).alias("diamond"))


def pair_report(lines: DataFrame) -> DataFrame:
    """Per page: lines, pairs, and pairs that only the centring rule allows."""
    pairs = line_pairs(lines).groupBy("page_id").agg(F.count("*").alias("n_pairs"), F.count_if("diamond").alias("n_diamond_only"))
    counts = lines.groupBy("page_id").agg(F.count("*").alias("n_lines"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return counts.join(pairs, "page_id", "left").select("page_id", "n_lines", zero("n_pairs"), zero("n_diamond_only"))


def _label(rows: Rows) -> Rows:
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in zip(rows["a_seq"], rows["b_seq"]):
        x, y = root(a), root(a if b is None else b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    seqs = sorted(parent)
    return {"page_id": rows["page_id"][:1] * len(seqs), "seq": seqs, "cluster": [root(v) for v in seqs]}


def page_components(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """(page_id, seq, cluster): the smallest seq that each line reaches by the pairs of its page."""
    alone = lines.select("page_id", F.col("seq").alias("a_seq"), F.lit(None).cast("int").alias("b_seq"))
    edges = pairs.select("page_id", "a_seq", "b_seq").unionByName(alone)
    return grouped(edges, ["page_id"], ["a_seq"], _label, "page_id long, seq int, cluster int")


def split_columns(clustered: DataFrame, key: list[str], gap: int = 12) -> DataFrame:
    """Adds ``side``: 1 for lines right of the widest free vertical strip of at least ``gap``, else 0.

    A cluster is only parted if every line falls wholly on one side (with 5 pixels of slack)."""
    over = Window.partitionBy(*key)
    order = over.orderBy("x0", "seq")
    x = clustered.withColumn("end", F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("x0").over(order))
    x = x.withColumn("free", F.when(F.col("next") - F.col("end") >= gap, F.col("next") - F.col("end")))
    best = F.max(F.when(F.col("free").isNotNull(), F.struct("free", (-F.col("end")).alias("neg"), F.floor((F.col("end") + F.col("next")) / 2).alias("at")))).over(over)["at"]
    x = x.withColumn("split_x", best)
    left, right = F.col("x1") <= F.col("split_x") + 5, F.col("x0") >= F.col("split_x") - 5
    n = F.count("*").over(over)
    clean = (F.count_if(left).over(over) + F.count_if(right).over(over) == n) & (F.count_if(left).over(over) > 0) & (F.count_if(right).over(over) > 0)
    x = x.withColumn("side", F.when(F.coalesce(clean, F.lit(False)) & right, 1).otherwise(0))
    return x.drop("end", "next", "free")


def split_stacked(clustered: DataFrame, key: list[str], with_text: bool = False) -> DataFrame:
    """Adds ``lobe``: 1 for lines below the break of a tall cluster of at least four lines, else 0.

    In a tall narrow cluster the first break after a sentence (or a gap of 25) counts; else the
    largest gap of at least 28 between the second line and the last."""
    over = Window.partitionBy(*key)
    order = over.orderBy("y0", "seq")
    x = clustered.withColumn("k", F.row_number().over(order)).withColumn("n", F.count("*").over(over))
    x = x.withColumn("v_gap", F.lead("y0").over(order) - F.col("y1"))
    h, w = F.max("y1").over(over) - F.min("y0").over(over), F.max("x1").over(over) - F.min("x0").over(over)
    tall = (h >= 1.1 * w) & (h >= 130)
    wide_gap = (F.col("v_gap") >= 25) & (F.col("k") >= 2)
    if with_text:
        x = x.withColumn("following", F.lead(F.trim("text")).over(order))
        ended = F.trim("text").rlike("[.!?:…]$") | (F.col("v_gap") >= 8)
        wide_gap = wide_gap | (ended & F.col("following").rlike("^\\p{Lu}") & (F.col("v_gap") >= 6))
    x = x.withColumn("tall_at", F.min(F.when(tall & wide_gap & (F.col("k") < F.col("n")), F.col("k"))).over(over))
    gaps = F.when((F.col("k") >= 2) & (F.col("k") < F.col("n")) & (F.col("v_gap") >= 28), F.struct("v_gap", (-F.col("k")).alias("neg")))
    x = x.withColumn("gap_at", -F.max(gaps).over(over)["neg"])
    at = F.when(F.col("n") >= 4, F.coalesce("tall_at", "gap_at"))
    return x.withColumn("lobe", F.when(F.col("k") > at, 1).otherwise(0)).drop("k", "n", "v_gap", "tall_at", "gap_at", "following")


def cluster_lines(lines: DataFrame, with_text: bool = False) -> DataFrame:
    """The whole clustering: pairs, components, columns, stacked lobes. Adds cluster, side, lobe.

    A window asks for a page's lines to lie together, which moves none where they do already; a task
    then clusters the whole pages of an Arrow batch at once and holds what is begun of the next."""
    kept = lines.where("page_id IS NOT NULL AND seq IS NOT NULL")
    schema = T.StructType([*kept.schema.fields, *(T.StructField(c, T.IntegerType()) for c in ("cluster", "side", "lobe"))])
    paged = kept.withColumn("_lines", F.count("*").over(Window.partitionBy("page_id")))

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            page = batch.column("page_id").to_numpy(zero_copy_only=False)
            if not len(page):
                continue
            new = np.flatnonzero(page[1:] != page[:-1]) + 1
            if held and held[-1].column("page_id")[-1].as_py() != page[0]:
                yield _clustered(held)
                held = []
            if len(new):
                yield _clustered([*held, batch.slice(0, new[-1])])
                held = []
            held.append(batch.slice(new[-1] if len(new) else 0))
        if held:
            yield _clustered(held)

    parted = paged.mapInArrow(run, schema)
    return split_stacked(parted.drop("lobe"), ["page_id", "cluster", "side"], True) if with_text else parted


def _clustered(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Whole pages, each in one run of rows, with cluster, side and lobe in place of the number of lines."""
    whole = pa.Table.from_batches(batches).drop_columns(["_lines"]).combine_chunks().to_batches()[0]
    page = whole.column("page_id").to_numpy(zero_copy_only=False)
    x0, y0, x1, y1 = (ca.numbers(whole.column(c)) for c in ("x0", "y0", "x1", "y1"))
    seq = whole.column("seq").to_numpy(zero_copy_only=False)
    group = np.cumsum(np.append(0, page[1:] != page[:-1]))
    cluster = ca.components(group, x0, y0, x1, y1, seq, MAX_DX, MAX_DY, CENTER_TOLERANCE)
    own = ca.numbered(group, cluster)
    _, right = ca.column_cuts(own, own.max() + 1, x0, x1, seq)
    own = ca.numbered(own, right)
    _, lower = ca.stacked_cuts(own, own.max() + 1, x0, y0, x1, y1, seq)
    added = [pa.array(v.astype("int32")) for v in (cluster, right, lower)]
    return pa.RecordBatch.from_arrays([*whole.columns, *added], [*whole.schema.names, "cluster", "side", "lobe"])


def envelopes(clustered: DataFrame, key: list[str], median: bool = True) -> DataFrame:
    """Box, size and mean confidence of each cluster, with its members in reading order.

    Lines are dealt by the first of ``key`` as they are, which sends less than gathered parts would."""
    members = F.sort_array(F.collect_list(F.struct("y0", "x0", "seq", (F.col("y1") - F.col("y0")).alias("h"))))
    out = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n_lines"), F.avg("conf_pct").alias("mean_conf"), members.alias("members")]
    x = clustered.repartition(key[0]).groupBy(*key).agg(*out)
    if median:
        heights = F.sort_array(F.filter(F.transform("members", lambda s: s["h"]), lambda h: h.isNotNull()))
        n = F.size(heights)
        x = x.withColumn("median_height", (F.get(heights, F.floor((n - 1) / 2).cast("int")) + F.get(heights, F.floor(n / 2).cast("int"))) / 2)
    return x.withColumn("members", F.array_join(F.transform("members", lambda s: s["seq"].cast("string")), ","))


def words_to_lines(words: DataFrame) -> DataFrame:
    """Greedy grouping of a page's words into lines: the first line whose last word overlaps in
    height by over 35 % and ends at most max(40, 1.8 h) before (15 after) the word's start.
    Adds ``line``. Order decides, so each page is one group of its (few) words."""

    def group(rows: Rows) -> Rows:
        lasts: list[tuple] = []
        out = []
        for x0, y0, x1, y1 in zip(rows["x0"], rows["y0"], rows["x1"], rows["y1"]):
            h = y1 - y0
            for i, (_, top, right, bottom) in enumerate(lasts):
                over, low = min(y1, bottom) - max(y0, top), max(1, min(h, bottom - top))
                if over > 0.35 * low and -15 <= x0 - right <= max(40, 1.8 * h):
                    break
            else:
                i = len(lasts)
                lasts.append(())
            lasts[i] = (x0, y0, x1, y1)
            out.append(i)
        return {"page_id": rows["page_id"], "seq": rows["seq"], "line": out}

    return grouped(words.select("page_id", "seq", "x0", "y0", "x1", "y1"), ["page_id"], ["y0", "x0", "seq"], group, "page_id long, seq int, line int")
