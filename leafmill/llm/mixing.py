"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are put into a fixed random order and cut into blocks of
``block_tokens`` tokens. Slot i of the mix has the golden-ratio point ``frac(i * phi)``; the
point's place among the cumulative weights names the slot's source, and the slot's rank among
its source's slots names the block. So any stretch of the mix holds the sources in proportion.
Everything is joins, windows over bounded groups, and sums of built-in functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import delete_written, quoted, written

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: 2**32 / golden ratio, as a whole number: the points are exact and the same in any engine.
GOLDEN, CIRCLE, PERIOD = 2654435769, 1 << 32, 1 << 31
#: Slots whose ranks are counted together, and strips of the circle for the look-up of a point.
CHUNK, STRIPS = 4096, 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """From (source, source_size): k (place in code-point order, null last), weight and target.

    Targets share the total by weight; one over ``most`` times its source stops there, and the
    excess is shared again. In the order of cap by weight the stopped ones come first, so
    running sums find them in one pass. The table has one row a source."""
    alone = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.row_number().over(by_name) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")).cast("long")
    t = sizes.withColumn("k", k).withColumn("weight", w).withColumn("cap", F.col("source_size") * most)
    t = t.withColumn("total", F.sum("source_size").over(alone)).withColumn("at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("at", "k")
    t = t.withColumn("cap_before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("weight_here", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("stopped", (F.col("total") - F.col("cap_before")) / F.col("weight_here") >= F.col("at"))
    free_tokens = F.col("total") - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("cap"))).over(alone), F.lit(0))
    free_weight = F.coalesce(F.sum(F.when(~F.col("stopped"), F.col("weight"))).over(alone), F.lit(0))
    t = t.withColumn("level", F.when(free_weight > 0, free_tokens / free_weight).otherwise(F.lit(0.0)))
    target = F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return t.select("source", "k", "source_size", "weight", target.alias("target"))


def slot_schedule(spark: SparkSession, sources: DataFrame, block_tokens: int) -> DataFrame:
    """One row a slot of the mix: slot, k, rank, block, tokens (what it takes of the block).

    The points give each source its slots up to a few; ranks still missing come at the end."""
    b = F.lit(block_tokens)
    s = sources.where((F.col("source_size") > 0) & (F.floor("target") > 0)).select("k", "source_size", F.floor("target").alias("goal"))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / b)).withColumn("rounds", F.expr("goal div source_size"))
    s = s.withColumn("rest", F.col("goal") - F.col("rounds") * F.col("source_size"))
    s = s.withColumn("slots", F.col("rounds") * F.col("blocks") + F.ceil(F.col("rest") / b))
    before = F.sum("slots").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("upto", before).withColumn("all", F.sum("slots").over(Window.partitionBy()))
    edge = lambda x: F.floor(x / F.col("all") * CIRCLE)
    s = written(s.select("*", edge(F.col("upto") - F.col("slots")).alias("lo"), edge(F.col("upto")).alias("hi")), "sources")
    # the source of a point: strips of the circle join equal, then the exact borders decide
    strip = CIRCLE // STRIPS
    arcs = s.where("hi > lo").select("k", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {strip}"), F.expr(f"(hi - 1) div {strip}"))).alias("strip"))
    count = s.agg(F.coalesce(F.max("all"), F.lit(0)).alias("n"))
    chunks = count.select(F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {CHUNK}"))).alias("chunk"), "n").repartition("chunk")
    points = chunks.select("chunk", "n", F.explode(F.sequence(F.col("chunk") * CHUNK, F.col("chunk") * CHUNK + CHUNK - 1)).alias("i")).where("i < n")
    points = points.withColumn("x", (F.col("i") % PERIOD) * GOLDEN % CIRCLE).withColumn("strip", F.expr(f"x div {strip}"))
    met = points.join(arcs, "strip").where("x >= lo and x < hi").select("i", "chunk", "k")
    per_chunk = met.groupBy("k", "chunk").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    per_chunk = per_chunk.select("k", "chunk", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    local = F.row_number().over(Window.partitionBy("k", "chunk").orderBy("i")) - 1
    ranked = met.withColumn("local", local).join(per_chunk, ["k", "chunk"]).select(F.col("i").alias("slot"), "k", (F.col("earlier") + F.col("local")).alias("rank"))
    given = per_chunk.join(met.groupBy("k", "chunk").agg(F.count("*").alias("own")), ["k", "chunk"]).groupBy("k").agg(F.max(F.col("earlier") + F.col("own")).alias("given"))
    late = s.join(given, "k", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < slots")
    late = late.select("k", (F.col("all") + F.col("upto") - F.col("slots")).alias("base"), F.explode(F.sequence(F.col("given"), F.col("slots") - 1)).alias("rank"))
    late = late.select((F.col("base") + F.col("rank")).alias("slot"), "k", "rank")
    kept = ranked.join(s.select("k", "slots"), "k").where("rank < slots").select("slot", "k", "rank").unionByName(late)
    block = F.col("rank") % F.col("blocks")
    length = F.least(b.cast("long"), F.col("source_size") - block * block_tokens)
    last = (F.col("rank") == F.col("slots") - 1) & (F.col("rest") % block_tokens != 0)
    tokens = F.when(last, F.least(length, F.col("rest") % block_tokens)).otherwise(length)
    out = kept.join(s.select("k", "blocks", "slots", "rest", "source_size"), "k").select("slot", "k", "rank", block.alias("block"), tokens.alias("tokens"), (tokens < length).alias("cut"))
    out.written_at = s.written_at
    return out


def sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"))


def _placed(docs: DataFrame, weights: tuple[int, ...], most: int, seed: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Each document's place in its source (doc_id, k, size, source_size, target, start), the
    sources with their targets, and the written tables that these read."""
    rows = written(sized(docs).withColumn("mark", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))).withColumn("bucket", F.substring("mark", 1, 3)), "sizes")
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    sources = source_targets(buckets.groupBy("source").agg(F.sum("n").alias("source_size")), weights, most)
    sources = written(sources, "targets")
    before = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    buckets = buckets.select("source", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("inside", inside - F.col("size")).alias("d")
    same = lambda a, b, *names: [F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{x}")) for x in names]
    placed = placed.join(buckets.alias("b"), same("d", "b", "source", "bucket")).select("d.doc_id", "d.source", "d.size", (F.col("d.inside") + F.col("b.before")).alias("start")).alias("p")
    placed = placed.join(sources.alias("s"), same("p", "s", "source")).select("doc_id", "k", "size", "source_size", "target", "start")
    return placed, sources, [rows, sources]


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, block_tokens: int = 2048, seed: str = "mix") -> DataFrame:
    """Mix ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken and first_slot.

    A document's size is its words; ``taken`` counts the words the mix takes of it, repeats
    included, and ``first_slot`` is the first slot of the schedule that takes one (null if none).
    A source takes its target, rounded down, to the word; whole rounds of the source repeat, so no
    document goes over ``most`` times its size. The order within a source is that of a hash of the
    id, so reruns agree.

    Null text has size 0 and nothing to take; a null source is a source of its own; null ids are
    kept; repeated rows count each; whole texts count, however long; without documents there are no rows. Other columns are left
    out. The largest source is dealt over hash buckets, never over one task."""
    placed, sources, _ = _placed(docs, weights, most, seed)
    plain = ~F.col("cut")
    cut = lambda name: F.max(F.when(F.col("cut"), F.col(name)))
    used = slot_schedule(docs.sparkSession, sources, block_tokens).groupBy("k", "block").agg(F.count_if(plain).alias("times"), F.coalesce(cut("tokens"), F.lit(0)).alias("part"), F.min(F.when(plain, F.col("slot"))).alias("slot"), cut("slot").alias("cut_slot"))
    # each document meets the blocks that it lies in
    first, final = F.expr(f"start div {block_tokens}"), F.expr(f"(start + size - 1) div {block_tokens}")
    spread = placed.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(first, final)).otherwise(F.array(F.lit(None).cast("long")))))
    offset = F.col("block") * block_tokens
    lo, hi = F.greatest(F.col("start") - offset, F.lit(0)), F.least(F.col("start") + F.col("size") - offset, F.lit(block_tokens))
    share = F.col("times") * (hi - lo) + F.greatest(F.least(hi, F.col("part")) - lo, F.lit(0))
    slot = F.least("slot", F.when(F.col("part") > lo, F.col("cut_slot")))
    met = spread.join(used.hint("merge"), ["k", "block"], "left").withColumn("share", F.coalesce(share, F.lit(0)).cast("long")).withColumn("slot", slot)
    # ``start`` tells apart repeated rows that have words; those without are counted
    whole = met.groupBy("doc_id", "k", "start", "size", "source_size", "target").agg(F.sum("share").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n"))
    copies = F.when(F.col("size") > 0, F.lit(1)).otherwise(F.col("n").cast("int"))
    whole = whole.withColumn("copies", copies)
    return whole.select("doc_id", "size", "source_size", "target", "taken", "first_slot", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("one")).drop("one")


def apply_mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, block_tokens: int = 2048, seed: str = "mix") -> DataFrame:
    """``docs`` with all its columns, whatever their names, as the mix takes them, in slot order.

    A document comes once for each round that reaches it (a round that ends inside of it takes it
    whole) at the slot of the block it begins in; not at all if no round reaches it, or if it has
    no words. Rows that share an id come together, where the first of them stands."""
    spark = docs.sparkSession
    placed, sources, used = _placed(docs, weights, most, seed)
    slots = slot_schedule(spark, sources, block_tokens)
    schedule = slots.select("k", "rank", "slot")
    goal = F.floor("target").cast("long")
    one = placed.where("size > 0").groupBy("doc_id").agg(F.min(F.struct("k", "start", "source_size", "target")).alias("x")).select("doc_id", "x.*")
    rounds = F.expr("floor(target) div source_size") + F.when(F.col("start") < goal % F.col("source_size"), 1).otherwise(0)
    blocks = F.ceil(F.col("source_size") / block_tokens)
    turns = one.withColumn("rounds", rounds).where("rounds > 0").select("doc_id", "k", "start", blocks.alias("blocks"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rounds") - 1)).alias("turn"))
    turns = turns.select("doc_id", "k", "start", (F.col("turn") * F.col("blocks") + F.expr(f"start div {block_tokens}")).alias("rank"))
    came = written(turns.join(schedule.hint("merge"), ["k", "rank"]).groupBy("doc_id").agg(F.collect_list(F.struct("slot", "start")).alias("slots")), "slots")
    delete_written(*used, slots)
    met = docs.select(F.struct(*quoted(docs)).alias("doc")).join(came.hint("merge"), F.col("doc.doc_id").eqNullSafe(came["doc_id"]))
    rows = met.select("doc", F.explode("slots").alias("at"))
    return rows.repartitionByRange("at.slot").sortWithinPartitions("at").select(*[F.col(f"doc.`{c}`") for c in docs.columns])


def oracle(weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, block_tokens: int = 2048, seed: str = "mix") -> str:
    """The same result as DuckDB SQL: words taken in closed form (whole rounds, then the first words
    of one more), slots from the points themselves."""
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
       md5('{seed}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mark FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, [{', '.join(map(str, weights))}][k % {len(weights)} + 1] AS weight, source_size * {most} AS cap, sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, CAST(cap AS DOUBLE) / weight AS edge FROM w),
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY edge, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
        sum(weight) OVER (ORDER BY edge, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_here FROM o),
x AS (SELECT *, CAST(total - cap_before AS DOUBLE) / CAST(weight_here AS DOUBLE) >= edge AS stopped FROM c),
l AS (SELECT *, CAST(total - coalesce(sum(cap) FILTER (WHERE stopped) OVER (), 0) AS DOUBLE) / CAST(sum(weight) FILTER (WHERE NOT stopped) OVER () AS DOUBLE) AS level FROM x),
t AS (SELECT source, k, source_size, CASE WHEN stopped THEN CAST(cap AS DOUBLE) ELSE level * weight END AS target FROM l),
b AS (SELECT *, CAST(floor(target) AS BIGINT) AS goal, (source_size + {block_tokens - 1}) // {block_tokens} AS blocks FROM t WHERE source_size > 0 AND floor(target) > 0),
r AS (SELECT *, goal // source_size AS rounds, goal % source_size AS rest FROM b),
n AS (SELECT *, rounds * blocks + (rest + {block_tokens - 1}) // {block_tokens} AS slots FROM r),
u AS (SELECT *, sum(slots) OVER (ORDER BY k) AS upto, sum(slots) OVER () AS all_slots FROM n),
a AS (SELECT *, CAST(floor(CAST(upto - slots AS DOUBLE) / CAST(all_slots AS DOUBLE) * {CIRCLE}) AS BIGINT) AS lo,
        CAST(floor(CAST(upto AS DOUBLE) / CAST(all_slots AS DOUBLE) * {CIRCLE}) AS BIGINT) AS hi FROM u),
q AS (SELECT i, i % {PERIOD} * {GOLDEN} % {CIRCLE} AS x FROM (SELECT unnest(range(coalesce((SELECT CAST(max(all_slots) AS BIGINT) FROM a), 0))) AS i)),
h AS (SELECT q.i AS slot, a.k, row_number() OVER (PARTITION BY a.k ORDER BY q.i) - 1 AS rank FROM q JOIN a ON q.x >= a.lo AND q.x < a.hi),
e AS (SELECT h.slot, h.k, h.rank FROM h JOIN a USING (k) WHERE h.rank < a.slots
      UNION ALL SELECT all_slots + upto - slots + rank, k, rank FROM (SELECT a.*, unnest(range(coalesce((SELECT count(*) FROM h WHERE h.k = a.k), 0), CAST(slots AS BIGINT))) AS rank FROM a)),
g AS (SELECT e.k, e.slot, e.rank % a.blocks AS block, e.rank = a.slots - 1 AND a.rest % {block_tokens} <> 0 AS last_one,
        least({block_tokens}, a.source_size - e.rank % a.blocks * {block_tokens}) AS length, a.rest % {block_tokens} AS part FROM e JOIN a USING (k)),
v AS (SELECT k, block, min(slot) FILTER (WHERE NOT (last_one AND part < length)) AS slot,
        max(slot) FILTER (WHERE last_one AND part < length) AS cut_slot, max(part) FILTER (WHERE last_one AND part < length) AS part FROM g GROUP BY k, block),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.k,
        CAST(sum(d.size) OVER (PARTITION BY t.k ORDER BY d.mark, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS BIGINT) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT p.k, p.start, min(least(v.slot, CASE WHEN v.part > greatest(p.start - z.block * {block_tokens}, 0) THEN v.cut_slot END)) AS first_slot
      FROM (SELECT k, start, size, unnest(range(start // {block_tokens}, (start + size - 1) // {block_tokens} + 1)) AS block FROM p WHERE size > 0) z
      JOIN p USING (k, start) LEFT JOIN v ON v.k = z.k AND v.block = z.block WHERE p.size > 0 GROUP BY p.k, p.start)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) // source_size * size
    + greatest(least(start + size, CAST(floor(target) AS BIGINT) % source_size) - start, 0) END AS BIGINT) AS taken,
  CAST(CASE WHEN size > 0 THEN first_slot END AS BIGINT) AS first_slot
FROM p LEFT JOIN f USING (k, start)"""
