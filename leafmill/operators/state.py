"""Keyed state as ordered folds: quotas, locked dictionaries, signatures, edits, learned thresholds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.similarity import Known, at_least, fuzzy_unique
from leafmill.operators.grouped import Rows, grouped


def period_key(ts: Column, period: str) -> Column:
    return F.date_format(ts, "yyyy-MM" if period == "monthly" else "yyyy-MM-dd")


def admit(requests: DataFrame, cap: int) -> DataFrame:
    """Requests (key, period, seq, amount) with ``admitted``: what fits under ``cap`` in its period, in order.

    A large request that does not fit does not block a later small one, so a running sum does not
    do. A task walks over its sorted rows and keeps one number, however many rows a period has."""

    def run(batches):
        used, now = 0, None
        for batch in batches:
            fits = []
            for key, period, amount in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if (key, period) != now:
                    used, now = 0, (key, period)
                fits.append(used + (amount or 0) <= cap)
                used += (amount or 0) * fits[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fits, pa.bool_())], [*batch.schema.names, "admitted"])

    rows = requests.select("key", "period", "seq", "amount")
    schema = T.StructType([*rows.schema.fields, T.StructField("admitted", T.BooleanType())])
    return rows.repartition("key", "period").sortWithinPartitions("key", "period", "seq").mapInArrow(run, schema)


def quota_status(usage: DataFrame, config: DataFrame, period: str) -> DataFrame:
    """Per service of ``config`` (service, cap): used in ``period``, what is left, whether it is open."""
    used = usage.where(F.col("period") == period).groupBy("service").agg(F.sum("amount").alias("used"))
    x = config.join(used, "service", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return x.select("service", "cap", "used", F.greatest(F.lit(0), F.col("cap") - F.col("used")).alias("left"), (F.col("used") < F.col("cap")).alias("open"))


def locked_terms(entries: DataFrame) -> DataFrame:
    """The dictionary after registering ``entries`` (seq, source_term, ...) in order.

    A locked entry is never overwritten: the winner is the first locked one, else the last; the
    first page stays that of the first registration. Aliases, if there are any, are those of all
    registrations that counted."""
    first_locked = F.min(F.when(F.col("locked"), F.col("seq"))).over(Window.partitionBy("source_term"))
    x = entries.withColumn("first_locked", first_locked).withColumn("first_seq", F.min("seq").over(Window.partitionBy("source_term")))
    x = x.withColumn("n", F.count("*").over(Window.partitionBy("source_term"))).where(F.coalesce(F.col("seq") <= F.col("first_locked"), F.lit(True)))
    more = []
    if "aliases" in x.columns:
        x = x.withColumn("aliases", F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases").over(Window.partitionBy("source_term"))))))
        more = ["aliases"]
    last = F.row_number().over(Window.partitionBy("source_term").orderBy(F.desc("seq")))
    return x.withColumn("r", last).where("r = 1").select("source_term", "canonical", "entry_type", "method", "locked", "seq", "first_seq", "n", *more)


def latest(rows: DataFrame, key: str, version: list[str]) -> DataFrame:
    """Last write wins: the newest row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(v) for v in version]))).where("_r = 1").drop("_r")


def learned_ratio(n: Column) -> Column:
    """The split threshold after ``n`` corrections: 0.65 and 0.02 for each, at most 0.75 (in hundredths)."""
    return F.least(F.lit(75), 65 + 2 * n)


def merged_signatures(samples: DataFrame, near: float = 30.0) -> DataFrame:
    """Running colour signatures of each key from samples (key, seq, colours, weights) in order.

    A new colour near a known one is blended into it by 1 / (samples + 1), else added with that
    share of its weight; weights are then normalised. Order decides: a task walks over its sorted
    rows and keeps the signature of one key, not its samples."""

    def merge(colours: list, weights: list, n: int, new: list, share: list) -> list:
        a = 1 / (n + 1)
        for c, w in zip(new, share):
            far = [sum((x - y) ** 2 for x, y in zip(c, k)) ** 0.5 for k in colours]
            if far and min(far) < near:
                i = far.index(min(far))
                colours[i] = [int(k * (1 - a) + x * a) for k, x in zip(colours[i], c)]
                weights[i] = weights[i] * (1 - a) + w * a
            else:
                colours.append(list(c))
                weights.append(w * a)
        total = sum(weights) or 1.0
        return [round(w / total, 3) for w in weights]

    names = ["key", "colours", "weights", "samples"]
    kinds = [pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.float64()), pa.int32()]

    def run(batches):
        now, colours, weights, n = None, [], [], 0
        done: list[tuple] = []
        for batch in batches:
            for key, new, share in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if n and key != now:
                    done.append((now, colours, weights, n))
                    colours, weights, n = [], [], 0
                now, weights = key, merge(colours, weights, n, new, share)
                n += 1
        if n:
            done.append((now, colours, weights, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)

    rows = samples.select("key", "seq", "colours", "weights")
    return rows.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(run, "key long, colours array<array<int>>, weights array<double>, samples int")


def unique_facts(facts: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Facts (key, seq, text) with ``added``: no earlier added fact of the key is that similar."""

    def fold(rows: Rows) -> Rows:
        return {"key": rows["key"], "seq": rows["seq"], "added": fuzzy_unique(rows["text"], threshold)}

    return grouped(facts.select("key", "seq", "text"), ["key"], ["seq"], fold, "key string, seq long, added boolean")


def captured_edits(edits: DataFrame) -> DataFrame:
    """Edits (key, seq, source, before, after) with their outcome, in order.

    trivial (nothing meaningful changed), updated (the source is known: its line is replaced),
    duplicate (a known line is as good as equal), added."""

    def fold(rows: Rows) -> Rows:
        known, out = Known(0.94), []
        bare = lambda t: "".join(ch for ch in (t or "").lower() if ch.isalnum())
        for source, before, after in zip(rows["source"], rows["before"], rows["after"]):
            a, b = bare(before), bare(after)
            if not b or a == b or (min(len(a), len(b)) >= 10 and at_least(a, b, 0.94)):
                out.append("trivial")
            elif bare(source) in known:
                same = bare(known[bare(source)]) == b
                out.append("duplicate" if same else "updated")
                known[bare(source)] = after
            elif known.similar(after):
                out.append("duplicate")
            else:
                out.append("added")
                known[bare(source)] = after
        return {"key": rows["key"], "seq": rows["seq"], "outcome": out}

    return grouped(edits.select("key", "seq", "source", "before", "after"), ["key"], ["seq"], fold, "key string, seq long, outcome string")


def cached(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their result, misses without copies) of requests by cache_key."""
    return requests.join(cache, "cache_key"), requests.join(cache, "cache_key", "left_anti").dropDuplicates(["cache_key"])
