"""Token-ID output: ORC files of integer token ids in document order, and their readers.

The ids are an ``array<int>`` column, so the ORC writer stores them with its integer
run-length encoding; ``doc_id`` carries row indexes and a Bloom filter. Files hold ascending,
disjoint ranges of ``doc_id``, so stripes are read in parallel and a look-up of a few
documents prunes files and stripes by their metadata.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import bounded, new_path, slices, written
from leafmill.llm.tokens import encoder

STORED = "doc_id long, part int, part_start long, ids array<int>"
#: Text bytes that one task encodes and writes.
TASK_BYTES = 64 << 20


def _tokenize(path: str, end_id: int):
    def run(batches):
        told, number = encoder(path), TaskContext.get().partitionId()
        before = 0
        for batch in batches:
            for part in slices(batch, 1):
                ids, borders = told.encode(part.column(1))
                n = part.num_rows
                ids = np.insert(ids, borders[1:], end_id).astype(np.int32)
                borders = borders + np.arange(n + 1)
                column = pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(ids))
                starts = pa.array(borders[:-1] + before)
                before += int(borders[-1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(n, number, np.int32)), starts, column], ["doc_id", "part", "part_start", "ids"])

    return run


def write_token_orc(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, *, files: int | None = None, stripe_bytes: int = 64 << 20, index_stride: int = 1000) -> None:
    """Encode ``docs`` (doc_id, text) and write the ids to ORC files in ascending doc_id order.

    Null text is an empty one (its row holds the end id alone); null ids sort first; rows that
    share an id are kept, next to each other; whole texts count, however long; no documents make
    files without rows. Other columns are left out. Texts are dealt by ranges of doc_id before they
    are encoded, to a task for each TASK_BYTES of them. A task's rows carry its number and their
    place in it, so they may lie in several files."""
    spark = docs.sparkSession
    bounded(spark)
    if not files:
        total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("n")).first()["n"]
        files = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    out = rows.mapInArrow(_tokenize(tokenizer_path, end_id), STORED)
    (
        out.write.option("orc.compress", "ZSTD").option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", index_stride).option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01).orc(path)
    )


def read_token_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows; with ``doc_ids``, only those, pruned by row indexes and Bloom filters."""
    out = spark.read.schema(STORED).orc(path)
    return out if doc_ids is None else out.where(F.col("doc_id").isin(doc_ids))


def _digest(batches):
    for batch in batches:
        ids = batch.column(3)
        borders = ids.offsets.to_numpy()
        flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).astype("<u4", copy=False)
        crc = np.fromiter((zlib.crc32(flat[a:b]) for a, b in zip(borders[:-1], borders[1:])), np.int64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(borders).astype(np.int64)), pa.array(crc)], ["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """One row a stored document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Rows carry their place within the task that wrote them; only one sum a task is needed besides.
    Without stored rows there are none."""
    rows = read_token_orc(spark, path)
    rows = written(rows.mapInArrow(_digest, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long"), "digest")
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(parts, "part").select("doc_id", (F.col("part_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_orc_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write ``docs`` as token ids, read the files back, and describe each document from them."""
    spark = docs.sparkSession
    path = new_path(spark, "ids")
    write_token_orc(docs, path, tokenizer_path, end_id)
    return token_digests(spark, path)
