"""The stream forms as queries: a finished table is read as a stream, drained, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators.state import period_key
from leafmill.plans.registry import register
from leafmill.plans.texts import ADMITTED_SQL
from leafmill.session import shared_folder
from leafmill.sources.tables import table
from leafmill.streaming import events as se


def _stream(spark, sf) -> DataFrame:
    # a pattern, as a stream takes no path of one file
    return se.event_stream(spark, f"{sf}/events.parque[t]", table(spark, sf, "events").schema)


def _drained(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """What a stream has written when all its input is read: its last state in complete mode, else all appended rows."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/leafmill-stream-{label}-{uuid.uuid4().hex}"
    ledger = se.Ledger(spark, path)

    def write(batch: DataFrame, epoch: int) -> None:
        ledger.write(epoch, {"rows": batch})

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = ledger.read("rows", stream.schema)
    return rows.where(F.col("batch") == (ledger.batches() or [0])[-1]).drop("batch") if mode == "complete" else rows.drop("batch")


@register("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT)) AS total FROM events GROUP BY 1, 2")
def stream_window_counts(spark, sf):
    x = _drained(se.windowed_counts(_stream(spark, sf)), "complete", "windows")
    return x.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@register("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf):
    x = _drained(se.sessions(_stream(spark, sf)), "complete", "sessions")
    return x.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "n")


@register(ADMITTED_SQL)
def stream_quota_admission(spark, sf):
    asked = _stream(spark, sf).select(F.col("user_id").alias("key"), period_key(F.col("ts"), "daily").alias("period"), F.col("event_id").alias("seq"), (F.col("event_id") % 7 + 1).alias("amount"))
    return _drained(se.admitted(asked, 8), "append", "admitted")


@register("SELECT user_id AS page_id, 'manual_' || event_type AS pattern_name, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY ALL")
def stream_fan_out(spark, sf):
    edits = _stream(spark, sf).select(F.col("user_id").alias("page_id"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("tool"))
    path = f"{shared_folder(spark)}/leafmill-stream-edits-{uuid.uuid4().hex}"
    se.fan_out(edits, f"{path}/out", f"{path}/state").awaitTermination()
    return se.Ledger(spark, f"{path}/out").read("events", se.EDIT_EVENTS).groupBy("page_id", "pattern_name").agg(F.count("*").alias("n"))


@register(ADMITTED_SQL)
def stream_quota_by_period(spark, sf):
    """Quota admission with state that goes when its day is over."""
    asked = _stream(spark, sf).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") % 7 + 1).alias("amount"), "ts")
    setting, store = se.TIMED_STORE
    before = spark.conf.get(setting)
    spark.conf.set(setting, store)
    try:
        return _drained(se.admitted_by_period(asked, 8, buckets=se.BUCKETS), "append", "periods")
    finally:
        spark.conf.set(setting, before)
