"""Stores with versions, ledgers of micro-batches, quotas that start anew."""

import datetime

import pytest
from pyspark.sql import functions as F

from leafmill.operators.state import admit, period_key
from leafmill.sources.versions import VersionedStore, changed_files
from leafmill.streaming import events as se

SCHEMA = "term string, meaning string"


def rows(spark, *pairs):
    return spark.createDataFrame([(i, k, v, "x") for i, (k, v) in enumerate(pairs)], "seq long, term string, meaning string, more string")


def held(df):
    return {r.term: r.meaning for r in df.collect()}


def files_of(folder):
    return {str(p.relative_to(folder)) for p in folder.rglob("*.parquet")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path), SCHEMA, "term", buckets=8)
    assert store.read().count() == 0 and store.versions() == []
    many = {f"t{i}": str(i) for i in range(200)}
    assert store.upsert(rows(spark, *many.items()), "seq") == 1
    before = files_of(tmp_path)
    assert len(before) == 8
    assert store.upsert(rows(spark, (" T7 ", "a"), ("t7", "b"), ("", "c"), ("new", "d")), "seq") == 2
    new = files_of(tmp_path) - before
    touched = {r.b for r in spark.createDataFrame([("t7",), ("new",)], "k string").select(store.bucket_of(F.col("k")).alias("b")).collect()}
    assert before <= files_of(tmp_path) and len(new) == len(touched) < 8
    assert held(store.read()) == many | {"t7": "b", "new": "d"} and held(store.read(1)) == many
    assert {r.bucket for r in store.changed(1).collect()} == touched and {"t7", "new"} <= set(held(store.changed(1)))
    assert store.changed(2).count() == 0 and held(store.changed(0)) == held(store.read())


def test_a_write_that_fails_leaves_the_old_version(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path), SCHEMA, "term", buckets=4)
    store.upsert(rows(spark, ("a", "1"), ("b", "2")), "seq")
    broken = rows(spark, ("a", "9"), ("c", "3")).withColumn("meaning", F.when(F.col("term") == "c", F.raise_error(F.lit("broken"))).otherwise(F.col("meaning")))
    with pytest.raises(Exception, match="broken"):
        store.upsert(broken, "seq")
    assert store.versions() == [1] and held(store.read()) == {"a": "1", "b": "2"}
    assert store.upsert(rows(spark, ("a", "3")), "seq") == 2 and held(store.read()) == {"a": "3", "b": "2"}


def test_a_second_writer_of_a_version_is_refused(spark, tmp_path, monkeypatch):
    store = VersionedStore(spark, str(tmp_path), SCHEMA, "term", buckets=2)
    store.upsert(rows(spark, ("a", "1")), "seq")
    late = VersionedStore(spark, str(tmp_path), SCHEMA, "term", buckets=2)
    store.upsert(rows(spark, ("a", "2")), "seq")
    monkeypatch.setattr(late, "versions", lambda: [1])
    with pytest.raises(Exception, match="manifest/2"):
        late.upsert(rows(spark, ("b", "3")), "seq")


def test_changed_files(spark, tmp_path):
    import os

    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "x"))
    for p in (tmp_path / "x").glob("*.parquet"):
        os.utime(p, (1_000_000_000, 1_000_000_000))
    spark.range(10, 12).coalesce(1).write.mode("append").parquet(str(tmp_path / "x"))
    since = datetime.datetime(2010, 1, 1)
    assert sorted(r.id for r in changed_files(spark.read.parquet(str(tmp_path / "x")), since).collect()) == [10, 11]


def test_a_batch_that_is_run_again_writes_nothing(spark, tmp_path):
    ledger = se.Ledger(spark, str(tmp_path))
    edits = spark.createDataFrame([(1, "brush"), (2, None)], "page_id long, tool string")
    assert ledger.read("events", se.EDIT_EVENTS).count() == 0
    assert ledger.write(0, se.edit_tables(edits)) and not ledger.write(0, se.edit_tables(edits))
    # a batch that broke off has left a table, but no name
    edits.write.parquet(f"{tmp_path}/edits/batch=1")
    assert ledger.batches() == [0] and ledger.read("edits", edits.schema).count() == 2
    assert ledger.write(1, se.edit_tables(edits))
    got = [(r.page_id, r.pattern_name, r.batch) for r in ledger.read("events", se.EDIT_EVENTS).orderBy("batch").collect()]
    assert got == [(1, "manual_brush", 0), (1, "manual_brush", 1)] and ledger.read("edits", edits.schema).count() == 4


def test_quotas_start_anew_and_ended_periods_are_forgotten(spark, tmp_path):
    day = lambda d, h=1: datetime.datetime(2024, 1, d, h)
    batches = [
        [(1, 5, 3, day(1)), (1, 4, 5, day(1)), (2, 6, 9, day(1)), (1, 7, 1, day(2))],
        [(1, 8, 4, day(1, 23)), (1, 9, 8, day(2))],
        [(1, 10, 2, day(9))],
        [(3, 11, 2, day(20))],
    ]
    schema = "key long, seq long, amount long, ts timestamp"
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    for i in range(len(batches)):  # files come in this order
        import os

        for p in (tmp_path / f"in/{i}").glob("*.parquet"):
            os.utime(p, (1_700_000_000 + 60 * i,) * 2)
    setting, timed = se.TIMED_STORE
    before = spark.conf.get(setting)
    spark.conf.set(setting, timed)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        out = se.Ledger(spark, str(tmp_path / "out"))
        q = se.admitted_by_period(stream, 8).writeStream.outputMode("append").foreachBatch(lambda b, e: out.write(e, {"rows": b}) and None).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(setting, before)
    got = {(r.key, r.period, r.seq): r.admitted for r in out.read("rows", "key long, period string, seq long, amount long, admitted boolean").collect()}
    whole = spark.createDataFrame([r for b in batches for r in b], schema)
    want = {(r.key, r.period, r.seq): r.admitted for r in admit(whole.select("key", period_key(F.col("ts"), "daily").alias("period"), "seq", "amount"), 8).collect()}
    assert got == want and len(got) == 8
    # the periods that the watermark has passed are gone; the day of the newest request is held
    state = spark.read.format("statestore").option("stateVarName", "used").load(str(tmp_path / "cp"))
    assert [(r.key.key, r.key.period, r.value.used) for r in state.select("key", "value").collect()] == [(3, "2024-01-20", 2)]
