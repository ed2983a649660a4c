"""Quotas of many keys: as the walk over sorted rows gives them, with one state for a group of keys."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leafmill.operators.state import admit, period_key
from leafmill.streaming import events as se

SCHEMA = "key long, seq long, amount long, ts timestamp"


@pytest.mark.parametrize("timed", [False, True])
def test_keys_of_a_period_share_their_states(spark, tmp_path, timed):
    days = [dt.datetime(2024, 1, d, 12) for d in (1, 2)]
    # two files, each with all keys in both days; one key is null
    rows = [[(k or None, b * 10_000 + k * 10 + i, (k + 3 * i) % 7 + 1, days[i % 2]) for k in range(300) for i in range(4)] for b in (0, 1)]
    for b, part in enumerate(rows):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{b}")
    setting, store = se.TIMED_STORE
    before = spark.conf.get(setting)
    if timed:
        spark.conf.set(setting, store)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        out = se.Ledger(spark, f"{tmp_path}/out")
        asked = stream.select("key", period_key(F.col("ts"), "daily").alias("period"), "seq", "amount")
        done = se.admitted_by_period(stream, 20, buckets=8) if timed else se.admitted(asked, 20, buckets=8)
        done.writeStream.outputMode("append").foreachBatch(lambda x, e: out.write(e, {"rows": x}) and None).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before)
    assert len(out.batches()) >= 2
    got = sorted(map(tuple, out.read("rows", se.GRANTED).drop("batch").collect()), key=lambda r: r[2])
    whole = spark.createDataFrame([r for part in rows for r in part], SCHEMA)
    want = sorted(map(tuple, admit(whole.select("key", period_key(F.col("ts"), "daily").alias("period"), "seq", "amount"), 20).collect()), key=lambda r: r[2])
    assert got == want and len(got) == 2400
    state = spark.read.format("statestore")
    state = state.option("stateVarName", "used") if timed else state
    assert state.load(f"{tmp_path}/cp").count() <= 16
