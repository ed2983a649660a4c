"""Product codes of vectors, learned on distinct parts.

A vector's components become whole numbers and are cut into equal parts. Equal parts at a position
are one row with a weight, so that Lloyd's algorithm runs over distinct rows however often a part
occurs: a task assigns its rows to the nearest entries and hands on one sum an entry. Codes and
errors then join back to the vectors by the part itself. Parts that very many vectors share are
dealt over several keys in that join; as each holds a thousandth of all vectors or more, there are
at most a thousand of them a position.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import bounded, delete_written, written

#: Whole numbers stay within this, so that squares and their sums over 64 components fit 64 bits.
LARGEST = 1 << 27
#: What holds one in so many of all rows is dealt over several keys.
HOT_SHARE = 1000
#: Rows whose distances to the entries are held together.
ROWS_AT_ONCE = 8192


def _whole(vectors: DataFrame) -> DataFrame:
    """vec_id, label and v, the components as whole numbers, of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label"), v.alias("v")).where("v is not null")
    rows = rows.where(F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))))
    number = lambda x: F.greatest(F.least(F.floor(256 * x), F.lit(LARGEST)), F.lit(-LARGEST)).cast("long")
    return rows.select("vec_id", "label", F.transform("v", number).alias("v"))


def _parts_of(v: Column, parts: int, width: int) -> Column:
    """The parts as an array of structs k0, k1, ...; missing components at the end are zeros."""
    one = lambda p: F.struct(*[F.coalesce(F.get(v, p * width + j), F.lit(0)).alias(f"k{j}") for j in range(width)])
    return F.array(*[one(p) for p in range(parts)])


def _matrix(batch: pa.RecordBatch, first: int, width: int) -> np.ndarray:
    return np.stack([batch.column(first + j).to_numpy() for j in range(width)], axis=1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry to each row, ties to the lower index; exact."""
    at, far = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for lo in range(0, len(x), ROWS_AT_ONCE):
        some = x[lo : lo + ROWS_AT_ONCE]
        d = np.zeros((len(some), len(book)), np.int64)
        for j in range(book.shape[1]):
            d += (some[:, j, None] - book[None, :, j]) ** 2
        near = d.argmin(1)
        at[lo : lo + ROWS_AT_ONCE], far[lo : lo + ROWS_AT_ONCE] = near, d[np.arange(len(some)), near]
    return at, far


def _by_position(batches, books: np.ndarray, width: int):
    """(batch, entry and distance of each row) with columns pos, k0, k1, ..."""
    for batch in batches:
        if batch.num_rows:
            pos, x = batch.column(0).to_numpy(), _matrix(batch, 1, width)
            at, far = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
            for p in np.unique(pos).tolist():
                here = np.flatnonzero(pos == p)
                at[here], far[here] = nearest(x[here], books[p])
            yield batch, pos.astype(np.int64), x, at, far


def _sums(books: np.ndarray, width: int):
    """Weighted sums and counts of each entry over the rows of a task."""
    shape = books.shape

    def run(batches):
        total, count = np.zeros((shape[0] * shape[1], width), np.int64), np.zeros(shape[0] * shape[1], np.int64)
        for batch, pos, x, at, _ in _by_position(batches, books, width):
            weight, cell = batch.column(1 + width).to_numpy(), pos * shape[1] + at
            np.add.at(total, cell, x * weight[:, None])
            np.add.at(count, cell, weight)
        met = np.flatnonzero(count)
        columns = [pa.array(np.repeat(met, width)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(met))), pa.array(total[met].reshape(-1)), pa.array(np.repeat(count[met], width))]
        yield pa.RecordBatch.from_arrays(columns, ["cell", "j", "total", "n"])

    return run


def _assigned(books: np.ndarray, width: int):
    def run(batches):
        for batch, _, _, at, far in _by_position(batches, books, width):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(far)], [*batch.schema.names, "code", "far"])

    return run


def lloyd(distinct: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks [position, entry, component] after ``rounds`` over weighted distinct parts."""
    width = books.shape[2]
    for _ in range(rounds):
        sums = distinct.mapInArrow(_sums(books, width), "cell long, j int, total long, n long").groupBy("cell", "j").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        new = books.reshape(-1, width).copy()
        for r in sums.collect():  # at most a row a component of the codebooks
            new[r.cell, r.j] = r.total // r.n
        books = new.reshape(books.shape)
    return books


def _dealt(key: Column, copies: Column) -> Column:
    """One of ``copies`` numbers by a hash of ``key``; 0 without copies."""
    return F.coalesce(F.pmod(F.xxhash64(key), copies), F.lit(0))


def compress(vectors: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """Code each vector of ``vectors`` (vec_id, embedding, label) by codebooks of its parts.

    Returns vec_id, code (two hex digits a part), error (squared distances to the entries, summed),
    label_error (error summed over equal labels, nulls together) and codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components are dropped. Repeated rows
    and null ids are coded like any row (null ids come last where the smallest ids are wanted;
    rows with one id come in the order of their components). Ties go to the lower entry. With
    fewer vectors than ``entries`` there are fewer entries. Vectors of another length than that of
    the smallest id have no parts to compare: their code and error are null. A length that
    ``parts`` doesn't divide is filled up with zeros. Components beyond 2**19 count as 2**19 (sums
    stay within 64 bits). No vectors give no rows; other columns are left out."""
    if entries > 256:
        raise ValueError("two hex digits hold 256 entries")
    spark = vectors.sparkSession
    bounded(spark)
    table = written(_whole(vectors).withColumn("row", F.monotonically_increasing_id()), "whole")
    first = [r.v for r in table.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()]  # at most ``entries`` rows
    length = len(first[0]) if first else 0
    width = max(1, -(-length // parts))
    start = np.zeros((max(1, sum(len(v) == length for v in first)), parts * width), np.int64)
    for i, v in enumerate(v for v in first if len(v) == length):
        start[i, :length] = v
    books = start.reshape(len(start), parts, width).transpose(1, 0, 2)

    keys = ["pos", *[f"k{j}" for j in range(width)]]
    same_length = F.size("v") == length
    spread = table.where(same_length).select("row", F.posexplode(_parts_of(F.col("v"), parts, width)).alias("pos", "part")).select("row", "pos", "part.*")
    distinct = written(spread.groupBy(*keys).agg(F.count("*").alias("weight")), "parts")
    books = lloyd(distinct, books, rounds)
    told = ",".join(map(str, books.reshape(-1).tolist())) if first else ""
    digest = hashlib.sha256(told.encode()).hexdigest()

    schema = ", ".join(["pos int", *[f"{k} long" for k in keys[1:]], "weight long, code int, far long"])
    coded = written(distinct.select(*keys, "weight").mapInArrow(_assigned(books, width), schema), "codes")
    n = table.count()
    least = max(1, n // HOT_SHARE)
    # parts that many vectors share: a bounded number, dealt over as many keys as they hold shares
    hot = coded.where(F.col("weight") > least).select(*keys, F.ceil(F.col("weight") / least).alias("copies"))
    sides = spread.join(F.broadcast(hot), keys, "left").withColumn("salt", _dealt(F.col("row"), F.col("copies"))).drop("copies")
    copies = F.when(F.col("weight") > least, F.ceil(F.col("weight") / least)).otherwise(F.lit(1)).cast("int")
    entriesof = coded.select(*keys, "code", "far", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"))
    met = sides.join(entriesof.hint("merge"), [*keys, "salt"]).select("row", F.struct("pos", "code").alias("at"), "far")
    digits = F.array_join(F.transform(F.array_sort(F.collect_list("at")), lambda x: F.lower(F.lpad(F.hex(x["code"]), 2, "0"))), "")
    by_row = met.groupBy("row").agg(digits.alias("code"), F.sum("far").alias("error"))  # ``parts`` entries each
    rows = written(table.select("row", "vec_id", "label").join(by_row.hint("merge"), "row", "left"), "coded")

    # errors of labels join back the same way
    label = F.col("label").alias("of")
    sums = written(rows.groupBy(label).agg(F.sum("error").alias("label_error"), F.count("*").alias("weight")), "labels")
    hot = sums.where(F.col("weight") > least).select("of", F.ceil(F.col("weight") / least).alias("copies"))
    same = F.col("l.of").eqNullSafe(F.col("r.of"))
    told = rows.select("row", "vec_id", "code", "error", label).alias("l").join(F.broadcast(hot).alias("r"), same, "left")
    told = told.select("l.*", _dealt(F.col("row"), F.col("copies")).alias("salt")).alias("l")
    spreads = sums.select("of", "label_error", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt")).hint("merge").alias("r")
    whole = told.join(spreads, F.col("l.of").eqNullSafe(F.col("r.of")) & (F.col("l.salt") == F.col("r.salt")))
    out = written(whole.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")), "compressed")
    delete_written(table, distinct, coded, rows, sums)
    return out


def oracle(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The same result as DuckDB SQL, for vectors of one length that ``parts`` divides."""
    rounds_sql = ""
    for i in range(rounds + 1):
        rounds_sql += f""",
a{i} AS (SELECT rid, pos, arg_min(e, [d, e]) AS e, min(d) AS d FROM (
   SELECT p.rid, p.pos, b.e, list_sum(list_transform(list_zip(p.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN b{i} b USING (pos)) GROUP BY rid, pos)"""
        if i < rounds:
            rounds_sql += f""",
m{i} AS (SELECT pos, e, list(f ORDER BY j) AS part FROM (SELECT a.pos, a.e, j, CAST(floor(CAST(sum(p.part[j]) AS DOUBLE) / count(*)) AS BIGINT) AS f
   FROM a{i} a JOIN p USING (rid, pos), (SELECT unnest(range(1, (SELECT max(len(part)) FROM p) + 1)) AS j) GROUP BY a.pos, a.e, j) GROUP BY pos, e),
b{i + 1} AS (SELECT b.pos, b.e, coalesce(m.part, b.part) AS part FROM b{i} b LEFT JOIN m{i} m USING (pos, e))"""
    return f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT rid, vec_id, pos, v[pos * len(v) // {parts} + 1 : (pos + 1) * len(v) // {parts}] AS part FROM v, range({parts}) t(pos)),
f AS (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT {entries}),
b0 AS (SELECT pos, e, part FROM p JOIN f USING (rid)){rounds_sql},
h AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, e)) AS digest FROM b{rounds}),
c AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY pos) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM v JOIN c USING (rid), h"""
