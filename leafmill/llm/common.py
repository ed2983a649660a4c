"""Shared plumbing of the corpus operators: shared-folder tables, Arrow slicing, token memo."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.session import BATCH_BYTES, bounded, shared_folder  # noqa: F401

#: Text bytes that one step inside an Arrow worker looks at together.
SLICE_BYTES = 6_000_000


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/leafmill-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    A lost executor then costs the tasks it ran, not the whole chain before it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished steps removed: Spark does that once their plans are
    collected as garbage, here and in the JVM, which takes more than one round."""
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def delete_written(*tables: DataFrame) -> None:
    """Remove tables made by ``written`` as soon as all that is read from them has been written."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def quoted(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever is in their names."""
    return [F.col(f"`{c}`") for c in df.columns]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for a row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES, between: int = 0) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``most`` bytes in a string column.

    Memory that is no longer used goes back behind each batch, or when ``between`` bytes have been
    read: workers stay for the next task, and what they hold adds up."""
    global _read
    n = batch.num_rows
    if not n:
        return
    lengths = text_lengths(batch.column(column))
    part = np.cumsum(lengths) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
    _read += int(lengths.sum())
    if _read >= between:
        _read = 0
        give_back()


#: Bytes that this worker has read since it last gave memory back.
_read = 0


def give_back() -> None:
    """Return free memory of this worker process to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_lengths(column: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text; a null counts as none."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def utf8_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and their borders in it (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, at, data = column.buffers()
    borders = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[borders[0] : borders[-1]], borders - borders[0]


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the concatenated runs ``starts[i] .. starts[i] + lengths[i]``."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Memo:
    """A bounded map from a piece of text to a value, in two generations.

    When the young one is full it becomes the old one; what is asked for again moves back.
    So memory stays bounded, whatever the vocabulary, and frequent pieces stay."""

    def __init__(self, make: Callable[[list[str]], list], half: int = 250_000):
        self.make, self.half = make, half
        self.young: dict = {}
        self.old: dict = {}

    def many(self, keys: list[str]) -> list:
        found = list(map(self.young.get, keys))
        missing = []
        for i, value in enumerate(found):
            if value is None:
                value = self.old.get(keys[i])
                if value is None:
                    missing.append(i)
                else:
                    found[i] = self.young[keys[i]] = value
        if missing:
            names = [keys[i] for i in missing]
            for i, key, value in zip(missing, names, self.make(names)):
                found[i] = self.young[key] = value
        if len(self.young) > self.half:
            self.old, self.young = self.young, {}
        return found
