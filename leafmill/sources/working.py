"""Working tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from leafmill.session import shared_folder


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what is used more than once is made once,
    plans stay small, and a lost executor costs the tasks it ran."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/leafmill-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables made by ``settled`` when all that is read from them has been written."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
