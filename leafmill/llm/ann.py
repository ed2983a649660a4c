"""Approximate nearest neighbours by an inverted multi-index.

Both halves of the unit vectors are quantised by codebooks of their own; a pair of centroids is
a cell. A query walks through the cells in the order of summed distance, by a heap over the two
sorted lists, until they hold enough vectors, and ranks what they hold by the exact measure.

How many vectors are enough depends on the data, so it is measured: for a bounded sample of
queries the true neighbours are found by brute force (one scan), and the number that reaches
the wanted recall on them is taken. Copies of a vector are one entry of the index.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import bounded, written

#: Bounds of what the driver gathers: vectors for the codebooks, queries for the measurement, centroids a half.
FIT_VECTORS, PROBE_QUERIES, MOST_CENTROIDS = 20_000, 64, 512
#: Vectors in a part of the index, which one task holds together; a cell of over twice that is dealt to several.
PART_ROWS = 4_000


def _valid(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return rows.where(finite & F.exists("v", lambda x: x != 0)).dropDuplicates(["vec_id", "v"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _codebook(x: np.ndarray, k: int, turns: int = 8) -> np.ndarray:
    """Lloyd's algorithm; a centroid without vectors moves to one of the worst served points."""
    centers = x[:k].copy()
    for _ in range(turns):
        d = (centers**2).sum(1) - 2 * x @ centers.T
        near = d.argmin(1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centers)
        np.add.at(total, near, x)
        full = count > 0
        centers[full] = total[full] / count[full, None]
        empty = np.flatnonzero(~full)
        if len(empty):
            far = d[np.arange(len(x)), near] + (x**2).sum(1)
            worst = np.argsort(-far, kind="stable")[: 8 * len(empty)]
            _, first = np.unique(x[worst], axis=0, return_index=True)  # different points only
            worst = worst[np.sort(first)][: len(empty)]
            centers[empty[: len(worst)]] = x[worst]
    return centers


def _distances(unit: np.ndarray, books: list[np.ndarray]) -> list[np.ndarray]:
    half = books[0].shape[1]
    return [(b**2).sum(1) - 2 * x @ b.T for b, x in zip(books, (unit[:, :half], unit[:, half:]))]


def _cells(unit: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    a, b = (d.argmin(1) for d in _distances(unit, books))
    return a * len(books[1]) + b


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells by summed distance until they hold ``enough`` vectors; empty ones are passed over."""
    a, b = np.argsort(first), np.argsort(second)
    x, y = first[a].tolist(), second[b].tolist()
    a, b, k, n = a.tolist(), b.tolist(), len(second), len(first)
    heap, out, held = [(x[0] + y[0], 0, 0)], [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * k + b[j]
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        if j + 1 < k:
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if not j and i + 1 < n:
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (q @ v.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1))


def _indexed(books, width):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cells = _cells(_unit(_matrix(batch.column(1), width)), books)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.astype(np.int64))], [*batch.schema.names, "cell"])

    return run


def _brute(probe: np.ndarray, own: np.ndarray, k: int, width: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ids, cells = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                scores = _cosines(probe, _matrix(batch.column(1), width))
                for i in range(len(probe)):
                    at = _best(np.where(ids == own[i], -9.0, scores[i]), ids, k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(scores[i][at]), pa.array(ids[at]), pa.array(cells[at])], ["probe", "score", "uid", "cell"])

    return run


def _parts(counts: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(first part of each cell, over how many parts it is dealt, number of parts).

    The centroids of either half are put into groups of neighbours; cells of a pair of groups lie
    next to each other, and runs of cells with PART_ROWS vectors make a part. So what a query
    visits is in few parts, however many there are."""
    held = np.flatnonzero(counts)
    groups = max(1, round((counts.sum() / PART_ROWS) ** 0.5))
    near = []
    for book in books:
        coarse = _codebook(book, min(groups, len(book)))
        near.append(((coarse**2).sum(1) - 2 * book @ coarse.T).argmin(1))
    a, b = held // len(books[1]), held % len(books[1])
    held = held[np.lexsort((b, a, near[1][b], near[0][a]))]
    first, copies = np.zeros(len(counts), np.int32), np.ones(len(counts), np.int32)
    part, room = -1, 0
    for cell, n in zip(held.tolist(), counts[held].tolist()):
        if n > room or n > 2 * PART_ROWS:
            part, room = part + 1, PART_ROWS
        first[cell] = part
        if n > 2 * PART_ROWS:
            copies[cell] = -(-n // PART_ROWS)
            part += int(copies[cell]) - 1
            room = 0
        room -= n
    return first, copies, part + 1


def _asked(books, counts, width, enough, first, copies):
    """For each query and part of the index that it visits, the cells to look into there."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            d1, d2 = _distances(_unit(_matrix(batch.column(1), width)), books)
            rows, part, cells = [], [], []
            for i in range(batch.num_rows):
                mine = np.array(walk(d1[i], d2[i], counts, enough), np.int64)
                wide = np.repeat(mine, copies[mine])
                at = first[wide] + np.arange(len(wide)) - np.repeat(np.cumsum(copies[mine]) - copies[mine], copies[mine])
                order = np.argsort(at, kind="stable")
                at, wide = at[order], wide[order]
                cut = np.flatnonzero(np.diff(at, prepend=-1))
                rows += [i] * len(cut)
                part += at[cut].tolist()
                cells += [wide[a:b] for a, b in zip(cut, np.append(cut[1:], len(at)))]
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), taken.column(0), taken.column(1), pa.array(cells, pa.list_(pa.int64()))], ["part", "uid", "v", "cells"])

    return run


def _dealt(first, copies):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cell, uid = batch.column(3).to_numpy(), batch.column(0).to_numpy()
                part = first[cell] + uid % copies[cell]
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *batch.columns], ["part", *batch.schema.names])

    return run


def _built(held: list[tuple]):
    """A part of the index as arrays in the order of its cells, and where each cell lies."""
    ids, v, cells = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(cells, kind="stable")
    ids, v, cells = ids[order], v[order], cells[order]
    names, at = np.unique(cells, return_index=True)
    place = dict(zip(names.tolist(), zip(at.tolist(), [*at[1:].tolist(), len(cells)])))
    return ids, v, np.linalg.norm(v, axis=1), place


def _ranked(asked: pa.RecordBatch, index, k: int, width: int) -> pa.RecordBatch:
    """The k best of a part for each query, by the exact measure, among the cells that it looks into."""
    ids, v, norms, place = index
    names, q = asked.column(2).to_numpy(), _matrix(asked.column(3), width)
    own = np.linalg.norm(q, axis=1)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for i, mine in enumerate(asked.column(4).to_pylist()):
        found = [np.arange(*place[c]) for c in mine if c in place]
        if found:
            found = np.concatenate(found)
            scores = v[found] @ q[i] / (norms[found] * own[i])
            best = _best(scores, ids[found], k)
            out.append((np.full(len(best), names[i]), ids[found][best], scores[best]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["query", "uid", "score"])


def _search(k: int, width: int):
    """Rows come by part, its vectors (kind 0) before its queries (kind 1): a task holds one part of
    the index and a batch of queries, however many there are."""

    def run(batches):
        part, held, index = None, [], None
        for batch in batches:
            parts, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = (np.flatnonzero((parts[1:] != parts[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(parts)]):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                if parts[a] != part:
                    part, held, index = parts[a], [], None
                if kinds[a] == 0:
                    held.append((piece.column(2).to_numpy(), _matrix(piece.column(3), width), piece.column(4).flatten().to_numpy()))
                elif held:
                    index = index or _built(held)
                    yield _ranked(piece, index, k, width)

    return run


def nearest_neighbours(vectors: DataFrame, is_query, *, k: int = 5, recall: float = 0.96) -> DataFrame:
    """For each row of ``vectors`` (vec_id, embedding) with ``is_query``, its k nearest of all other rows.

    Nearness is the cosine in double precision on the vectors as they are. Returns query_id, rank
    (from 1), vec_id and score, ties to smaller vec_id; fewer where there are fewer candidates.

    Null vectors, zero vectors, vectors with a null, NaN or infinite component and rows without
    an id take no part; nor do vectors of another length than the most frequent one. Repeated
    rows are one; other columns are left out; without vectors or queries there are no rows. The codebooks are fitted on at most FIT_VECTORS vectors (smallest hashes); all
    are indexed. ``recall`` is aimed at on at most PROBE_QUERIES queries, as measured; vectors
    without any structure need a third of all to be visited for 0.96."""
    spark = vectors.sparkSession
    bounded(spark)
    rows = written(_valid(vectors), "vectors")
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    result = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], result)
    width = lengths["n"]
    rows = rows.where(F.size("v") == width)
    # one entry a distinct vector, with as many ids as an answer can need
    limited = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    entries = limited.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.get("ids", 0).alias("uid"), "v", "ids")
    entries = written(entries, "entries")
    n = entries.count()
    fit = np.array([r["v"] for r in entries.select("v", F.xxhash64("uid").alias("h")).orderBy("h").limit(FIT_VECTORS).collect()])
    centroids = int(min(MOST_CENTROIDS, max(4, 2 ** round(np.log2(max(n / 3, 1)) / 2)), len(fit)))
    unit, half = _unit(fit), width // 2
    books = [_codebook(unit[:, :half], centroids), _codebook(unit[:, half:], centroids)]
    schema = "uid long, v array<double>, ids array<long>, cell long"
    index = written(entries.mapInArrow(_indexed(books, width), schema), "index")
    per_cell = index.groupBy("cell").count().toPandas()  # MOST_CENTROIDS squared rows at most
    counts = np.zeros(centroids * centroids, np.int64)
    counts[per_cell["cell"].to_numpy(np.int64)] = per_cell["count"].to_numpy(np.int64)

    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v")
    asked = written(asked.join(entries.select("uid", "v"), "v").select("query_id", "uid"), "asked")
    queries = index.join(asked.select("uid").distinct(), "uid", "left_semi").select("uid", "v")
    probes = queries.orderBy(F.xxhash64("uid")).limit(PROBE_QUERIES).collect()
    if not probes:
        return spark.createDataFrame([], result)
    probe, own = np.array([p["v"] for p in probes]), np.array([p["uid"] for p in probes])
    true = index.select("uid", "v", "cell").mapInArrow(_brute(probe, own, k, width), "probe int, score double, uid long, cell long")
    best = Window.partitionBy("probe").orderBy(F.desc("score"), "uid")
    true = true.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("probe", "cell").toPandas()
    need = []
    d1, d2 = _distances(_unit(probe), books)
    for i, mine in true.groupby("probe"):
        order = np.argsort((d1[i][:, None] + d2[i][None, :]).ravel(), kind="stable")
        upto = np.empty(len(order), np.int64)
        upto[order] = np.cumsum(counts[order])
        need += upto[mine["cell"].to_numpy(np.int64)].tolist()
    enough = max(int(np.quantile(need, recall, method="higher")) if need else 0, 64 * k)

    first, copies, parts = _parts(counts, books)
    left = queries.repartition(parts).mapInArrow(_asked(books, counts, width, enough, first, copies), "part int, uid long, v array<double>, cells array<long>")
    left = left.select("part", F.lit(1).alias("kind"), "uid", "v", "cells")
    right = index.mapInArrow(_dealt(first, copies), f"part int, {schema}").select("part", F.lit(0).alias("kind"), "uid", "v", F.array("cell").alias("cells"))
    both = right.unionByName(left).repartition(parts, "part").sortWithinPartitions("part", "kind")
    met = both.mapInArrow(_search(k + 1, width), "query long, uid long, score double")
    top = met.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "uid"))).where(F.col("r") <= k + 1)
    named = top.join(index.select("uid", "ids"), "uid").select("query", "score", F.explode("ids").alias("vec_id"))
    flat = named.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))), 1, k + 1).alias("found"))
    out = asked.join(flat, asked["uid"] == flat["query"])
    out = out.select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return out.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
