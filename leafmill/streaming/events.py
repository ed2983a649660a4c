"""Streams of quality events: windowed counts and quota admission. Extensions: the batch system that
this follows has no unbounded input of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files of a folder as a stream of events, with ``ts`` as a timestamp that can be watermarked."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events and values by window and type; with ``slide`` windows overlap."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Runs of a user's events with no longer pause than ``gap``."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


#: Groups that the keys of a period are dealt to: a group is one call into Python and one state, however many keys it has.
BUCKETS = 32

#: Used by each key of a group, in two lists of one length.
USED = "keys array<long>, used array<long>"
GRANTED = "key long, period string, seq long, amount long, admitted boolean"


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")


def _granted(period: str, frames: Iterator[pd.DataFrame], held: tuple | None, cap: int) -> tuple[pd.DataFrame, tuple]:
    """The requests of a group of keys with ``admitted``, and what its keys have used after them.

    Each key is walked over by seq; ``held`` and what is returned are as USED."""
    known = dict(zip(*held)) if held else {}
    x = pd.concat([f[["key", "seq", "amount"]] for f in frames]).sort_values(["key", "seq"])  # stable; a null key comes last
    flags, now, used, begun = [], None, 0, False
    for key, amount in zip(x["key"].astype(object).where(x["key"].notna(), None).tolist(), x["amount"].tolist()):
        if not begun or key != now:
            if begun:
                known[now] = used
            now, begun = key, True
            used = known.get(key, 0)
        fits = used + amount <= cap
        used += amount if fits else 0
        flags.append(fits)
    known[now] = used
    done = pd.DataFrame({"key": x["key"], "period": period, "seq": x["seq"], "amount": x["amount"], "admitted": flags})
    return done, ([None if k is None else int(k) for k in known], [int(v) for v in known.values()])


def admitted(requests: DataFrame, cap: int, buckets: int = BUCKETS) -> DataFrame:
    """The stream form of ``operators.state.admit``: requests (key, period, seq, amount), in batch order by seq.

    The state of a key and period is one number; the keys of a period are held in ``buckets`` groups
    (the same number as long as a checkpoint lives)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, used = _granted(key[1], frames, state.get if state.exists else None, cap)
        state.update(used)
        yield done

    x = requests.select(_bucket(F.col("key"), buckets), "period", "key", "seq", "amount")
    return x.groupBy("bucket", "period").applyInPandasWithState(step, GRANTED, USED, "append", GroupStateTimeout.NoTimeout)


#: The state store that timers and typed state need.
TIMED_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Quota(StatefulProcessor):
    """What a key has used in a period; forgotten by a timer when the period is over.

    Of a micro-batch only numbers of the order and the amount are held, sixteen bytes a request."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.used = handle, handle.getValueState("used", "used long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seqs, amounts, end = [], [], None
        for frame in rows:
            seqs.append(frame["seq"].to_numpy(np.int64))
            amounts.append(frame["amount"].to_numpy(np.int64))
            end = int(frame["period_end"].iloc[0])
        seq, amount = np.concatenate(seqs), np.concatenate(amounts)
        order = np.argsort(seq, kind="stable")
        held = self.used.get()
        used, flags = held[0] if held else 0, np.zeros(len(seq), bool)
        for i in order.tolist():
            if used + int(amount[i]) <= self.cap:
                used += int(amount[i])
                flags[i] = True
        if not held and end > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(end)
        self.used.update((used,))
        yield pd.DataFrame({"key": key[0], "period": key[1], "seq": seq[order], "amount": amount[order], "admitted": flags[order]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.used.clear()
        yield from ()

    def close(self) -> None:
        pass


class SharedQuota(Quota):
    """What the keys of a group have used in a period, as one state; forgotten by one timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.used = handle, handle.getValueState("used", USED)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        held = self.used.get()
        done, used = _granted(key[1], frames, held, self.cap)
        end = int(frames[0]["period_end"].iloc[0])
        if not held and end > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(end)
        self.used.update(used)
        yield done


def admitted_by_period(requests: DataFrame, cap: int, period: str = "day", late: str = "1 day", buckets: int | None = None) -> DataFrame:
    """Requests (key, seq, amount, ts) with their period and ``admitted``, as ``operators.state.admit``.

    Each key starts anew when the period ("day" or "month", in UTC) turns; the state of a period
    goes when the watermark, ``late`` behind the newest request, has passed its end. The session
    must use TIMED_STORE.

    Each key has a state and a timer of its own, which costs some milliseconds a key and period; with
    ``buckets`` the keys of a period share as many (the same number as long as a checkpoint lives)."""
    begin = F.date_trunc(period, "ts")
    after = F.add_months(begin, 1).cast("timestamp") if period == "month" else begin + F.expr("INTERVAL 1 DAY")
    x = requests.withWatermark("ts", late).select("key", F.date_format("ts", "yyyy-MM" if period == "month" else "yyyy-MM-dd").alias("period"), "seq", "amount", F.unix_millis(after).alias("period_end"), "ts")
    if buckets:
        return x.withColumn("bucket", _bucket(F.col("key"), buckets)).groupBy("bucket", "period").transformWithStateInPandas(SharedQuota(cap), GRANTED, "Append", "EventTime")
    return x.groupBy("key", "period").transformWithStateInPandas(Quota(cap), GRANTED, "Append", "EventTime")


class Ledger:
    """Tables that a stream writes each micro-batch to exactly once, in one folder.

    A batch goes to a folder of its own for each table; then one small file names the batch as done.
    Readers see only batches that are named. A batch that is run again finds its name and writes
    nothing; one that broke off before has no name, so its folders are written over."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _done(self, epoch: int):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/done/{epoch}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def write(self, epoch: int, tables: dict[str, DataFrame]) -> bool:
        """Whether the batch was written now; not if it had been before."""
        files, name = self._done(epoch)
        if files.exists(name):
            return False
        for table, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/batch={epoch}")
        files.create(name, True).close()
        return True

    def batches(self) -> list[int]:
        files, path = self._done(0)
        top = path.getParent()
        return sorted(int(s.getPath().getName()) for s in files.listStatus(top)) if files.exists(top) else []

    def read(self, table: str, schema) -> DataFrame:
        """All rows of the named batches, with ``batch``: the order in which they arrived."""
        found = [f"{self.folder}/{table}/batch={b}" for b in self.batches()]
        if not found:
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
        x = self.spark.read.schema(schema).parquet(*found)
        return x.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), "/batch=([0-9]+)/", 1).cast("long"))


EDIT_EVENTS = "page_id long, pattern_name string"


def edit_tables(batch: DataFrame) -> dict[str, DataFrame]:
    """A batch of edits as the log and the events that they raise."""
    return {"edits": batch, "events": batch.where("tool is not null").select("page_id", F.concat(F.lit("manual_"), "tool").alias("pattern_name"))}


def fan_out(stream: DataFrame, folder: str, checkpoint: str):
    """Write a stream of edits to the log and, of the same micro-batch, the events they raise, once each."""
    ledger = Ledger(stream.sparkSession, folder)

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.persist()  # both tables from one reading of the batch
        ledger.write(epoch, edit_tables(rows))
        rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
