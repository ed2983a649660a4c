"""Stores and streams."""

import json

from pyspark.sql import functions as F

from leafmill.sources import stores as ss
from leafmill.streaming import events as se


def put(path, value):
    path.write_text(json.dumps(value), encoding="utf-8")
    return str(path)


def test_json_shapes(spark, tmp_path):
    terms = [{"source_term": "a", "canonical_uzbek": "x"}, {"source_term": "b", "locked": False}]
    listed, held = put(tmp_path / "l.json", terms), put(tmp_path / "h.json", {"version": 2, "terms": terms})
    for path in (listed, held):
        x = ss.with_defaults(ss.read_json(spark, path, ss.TERM, "terms"), ss.DEFAULTS["terms"])
        assert sorted((r.source_term, r.locked, r.method) for r in x.collect()) == [("a", True, "fixed"), ("b", False, "fixed")]
    pairs = ss.read_map(spark, put(tmp_path / "g.json", {"terms": {" A ": " b ", "  ": "c"}, "updated_at": "x"}))
    assert [tuple(r) for r in pairs.collect()] == [("A", "b")]
    assert ss.removed(pairs, "a").count() == 0


def test_fallback_and_seeds(spark, tmp_path):
    empty, full = spark.createDataFrame([], "k string"), spark.createDataFrame([("x",)], "k string")

    def broken():
        raise OSError("no connection")

    assert ss.first_available(broken, lambda: empty).count() == 0
    assert ss.first_available(broken, lambda: empty, lambda: full, empty_is_missing=True).count() == 1
    schema = "name string, tone string, traits array<string>"
    p = spark.createDataFrame([("Jo", "", []), ("Al", "dry", ["calm"])], schema)
    s = spark.createDataFrame([("jo", "warm", ["kind"]), ("Bo", "loud", None)], schema)
    assert sorted((r.name, r.tone, tuple(r.traits or ())) for r in ss.seeded(p, s).collect()) == [("Al", "dry", ("calm",)), ("Bo", "loud", ()), ("Jo", "warm", ("kind",))]


def test_upsert_append_migrate(spark, tmp_path):
    store = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    rows = spark.createDataFrame([(1, " A ", "3"), (2, "a", "4"), (3, "", "5"), (4, "c", "6")], "seq long, k string, v string")
    assert sorted(map(tuple, ss.upserted(store, rows, "k").collect())) == [("a", "4"), ("b", "2"), ("c", "6")]
    path = str(tmp_path / "events")
    for _ in range(2):
        ss.append(spark.createDataFrame([("p", "7", "unknown")], "page string, bubble_id string, extra string"), path, ss.EVENT, ss.DEFAULTS["events"])
    assert [(r.page, r.bubble_id, r.severity) for r in spark.read.parquet(path).collect()] == [("p", 7, "auto_fix")] * 2
    counts = ss.migrated(spark.createDataFrame([("p", "1"), ("p", "x")], "page string, bubble_id string"), str(tmp_path / "m"), ss.EVENT)
    assert counts == {"written": 1, "refused": 1} and spark.read.parquet(str(tmp_path / "m")).count() == 1


def test_lookup_and_vocabulary(spark):
    profiles = spark.createDataFrame([(1, "Peter Parker", ["spidey"]), (2, "Parker", None)], "seq int, name string, aliases array<string>")
    names = spark.createDataFrame([("parker",), ("SPIDEY",), ("nobody",)], "asked string")
    assert {r.asked: r.profile for r in ss.alias_lookup(names, profiles).collect()} == {"parker": "Parker", "SPIDEY": "Peter Parker", "nobody": None}
    assert sorted(r.word for r in ss.vocabulary(profiles, "name").collect()) == ["PARKER", "PETER"]


def drain(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_streams_agree_with_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = str(tmp_path / "in")
    events.write.parquet(folder)
    stream = se.event_stream(spark, folder, events.schema)
    drain(se.windowed_counts(stream), "complete", "counted")
    batch = se.windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, batch.collect()))
    from leafmill.operators.state import admit, period_key

    ask = lambda df: df.select(F.col("user_id").alias("key"), period_key(F.col("ts"), "daily").alias("period"), F.col("event_id").alias("seq"), (F.col("event_id") % 7 + 1).alias("amount"))
    drain(se.admitted(ask(stream), 8), "append", "granted")
    assert sorted(map(tuple, spark.table("granted").collect())) == sorted(map(tuple, admit(ask(events), 8).collect()))
    q = se.fan_out(stream.select(F.col("user_id").alias("page_id"), F.when(F.col("event_type") == "error", "brush").alias("tool")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/edits")).count() == events.count()
    assert spark.read.parquet(str(tmp_path / "out/events")).count() == events.where("event_type = 'error'").count()
