"""Sessions and shipping of this package to the executors' Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


#: Bytes of a batch on its way to a Python worker.
BATCH_BYTES = 6_000_000


def bounded(spark: SparkSession) -> None:
    """Have rows go to Python workers in batches of bounded bytes, not only of 10,000 rows: texts
    may be long, and both sides hold a batch whole. Holds for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def local_session(cores: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, as the tests and the bench use it."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("leafmill")
    base = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, unless their path has it already."""
    app = spark.sparkContext.applicationId
    if app in _shipped or str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    top = Path(tempfile.mkdtemp(prefix="leafmill-"))  # read by Spark as long as the application runs
    shutil.copytree(ROOT, top / "tree" / ROOT.name, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(top / ROOT.name), "zip", top / "tree"))
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none and runs on one machine (tests) a local folder is set up."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    made = os.path.join(tempfile.gettempdir(), f"leafmill-{os.getpid()}")
    os.makedirs(made, exist_ok=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made
