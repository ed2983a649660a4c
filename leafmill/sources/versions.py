"""Keyed stores with versions: only the buckets that a write touches are written, a manifest is swapped last.

A store is a folder: ``data/<version>/bucket=<b>`` holds rows, ``manifest/<version>`` names for each
bucket the version that wrote it last. A version exists when its manifest does, and a manifest is
created once; so a write that breaks off, and a second writer that comes later, change nothing.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def changed_files(df: DataFrame, since: datetime) -> DataFrame:
    """The rows of those files under ``df`` that were written after ``since``; the others aren't opened."""
    return df.where(F.col("_metadata.file_modification_time") > F.lit(since))


class VersionedStore:
    """Rows by a key (text, in small letters, trimmed), dealt over ``buckets`` by the key's hash."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        self.schema = T.StructType.fromDDL(schema)

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        files, top = self._path("manifest")
        return sorted(int(s.getPath().getName()) for s in files.listStatus(top)) if files.exists(top) else []

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """bucket -> the version that wrote it last; of the newest version by default."""
        found = self.versions()
        if not found or version == 0:
            return {}
        files, path = self._path(f"manifest/{found[-1] if version is None else version}")
        stream = files.open(path)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return {int(b): v for b, v in json.loads(text).items()}

    def bucket_of(self, key: Column) -> Column:
        return (F.conv(F.substring(F.md5(key), 1, 6), 16, 10).cast("long") % self.buckets).cast("int")

    def _normal(self, rows: DataFrame) -> DataFrame:
        x = rows.withColumn(self.key, F.lower(F.trim(F.col(self.key)))).where(F.col(self.key) != "")
        return x.withColumn("bucket", self.bucket_of(F.col(self.key)))

    def _read(self, manifest: dict[int, int]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        paths = [f"{self.folder}/data/{v}/bucket={b}" for b, v in sorted(manifest.items())]
        if not paths:
            return self.spark.createDataFrame([], schema)
        x = self.spark.read.schema(self.schema).parquet(*paths)
        return x.withColumn("bucket", F.regexp_extract(F.col("_metadata.file_path"), "/bucket=([0-9]+)/", 1).cast("int"))

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version)).drop("bucket")

    def changed(self, since: int) -> DataFrame:
        """The rows, with ``bucket``, of what was written after version ``since``: all that a holder
        of that version has to read again. Other files aren't opened."""
        old = self.manifest(since)
        return self._read({b: v for b, v in self.manifest().items() if old.get(b) != v})

    def upsert(self, rows: DataFrame, order: str) -> int:
        """Write ``rows``; the last by ``order`` of a key wins over earlier ones and over the store.

        Returns the new version. Blank keys are refused. Only buckets of keys in ``rows`` are read
        and written. Raises if another writer has made that version meanwhile."""
        manifest = self.manifest()
        version = (self.versions() or [0])[-1] + 1
        new = self._normal(rows)
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # at most ``buckets``
        names = [f.name for f in self.schema.fields]
        old = self._read({b: v for b, v in manifest.items() if b in touched}).select(*names, "bucket", F.lit(None).cast("long").alias("_order"))
        both = old.unionByName(new.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields], "bucket", F.col(order).cast("long").alias("_order")))
        newest = F.row_number().over(Window.partitionBy("bucket", self.key).orderBy(F.col("_order").desc_nulls_last()))
        kept = both.withColumn("_r", newest).where("_r = 1").select(*names, "bucket")
        kept.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.folder}/data/{version}")
        files, path = self._path(f"manifest/{version}")
        text = json.dumps({**manifest, **dict.fromkeys(touched, version)})
        stream = files.create(path, False)  # fails if there is one
        stream.write(bytearray(text.encode()))
        stream.close()
        return version
