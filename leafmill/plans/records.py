"""Queries over single records and small decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.functions.similarity import sequence_ratio
from leafmill.operators import lines as ln
from leafmill.operators import records as rc
from leafmill.plans.geometry import CLUSTER_SQL
from leafmill.plans.registry import register
from leafmill.sources.tables import table, view


@register("SELECT page_id, seq, [[CAST(round_even(x0 * CAST(0.5 AS DOUBLE), 0) AS INT), CAST(round_even(y0 * CAST(1.25 AS DOUBLE), 0) AS INT)], [CAST(round_even(x1 * CAST(0.5 AS DOUBLE), 0) AS INT), CAST(round_even(y1 * CAST(1.25 AS DOUBLE), 0) AS INT)]] AS contour FROM lines_v")
def rescale_contours(spark, sf):
    point = lambda a, b: F.array(F.col(a), F.col(b))
    return view(spark, sf, "lines_v").select("page_id", "seq", rc.rescaled(F.array(point("x0", "y0"), point("x1", "y1")), 0.5, 1.25).alias("contour"))


@register("SELECT page_id, seq, CASE WHEN n > 0 THEN dx / n ELSE 0.0 END AS ux, CASE WHEN n > 0 THEN dy / n ELSE 0.0 END AS uy FROM (SELECT *, sqrt(dx * dx + dy * dy) AS n FROM (SELECT page_id, seq, CAST(x0 - 300 AS DOUBLE) AS dx, CAST(y0 - 200 AS DOUBLE) AS dy FROM lines_v))")
def unit_vectors(spark, sf):
    v = rc.unit_vector((F.col("x0") - 300).cast("double"), (F.col("y0") - 200).cast("double"))
    return view(spark, sf, "lines_v").select("page_id", "seq", v.alias("v")).select("page_id", "seq", F.col("v.x").alias("ux"), F.col("v.y").alias("uy"))


@register("SELECT page_id, seq, greatest(px0 + 5, least(px1 - 5, x1 + 3 * (seq % 3 - 1) * 40)) AS x, greatest(py0 + 5, least(py1 - 5, y1 + 3 * (seq % 2) * 40)) AS y FROM lines_v, panels_v WHERE panel_idx = 1 + page_id % 4")
def ray_projection(spark, sf):
    lines = view(spark, sf, "lines_v").withColumn("panel_idx", (1 + F.col("page_id") % 4).cast("int"))
    x = lines.join(F.broadcast(view(spark, sf, "panels_v")), "panel_idx")  # four rows
    p = rc.projected(F.col("x1"), F.col("y1"), 3 * (F.col("seq") % 3 - 1), 3 * (F.col("seq") % 2), F.lit(40), tuple(F.col(c) for c in ("px0", "py0", "px1", "py1")))
    return x.select("page_id", "seq", p.alias("p")).select("page_id", "seq", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


@register("SELECT page_id, seq, CASE WHEN a < 2000 THEN 3.0 WHEN a < 5000 THEN 2.0 ELSE 1.5 END AS scale FROM (SELECT page_id, seq, (x1 - x0) * (y1 - y0) AS a FROM lines_v)")
def adaptive_scale(spark, sf):
    a = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return view(spark, sf, "lines_v").select("page_id", "seq", rc.step(a, [(2000, 3.0), (5000, 2.0)], 1.5).alias("scale"))


@register("SELECT event_id, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS day, sha256(event_type || '|' || user_id || '|' || coalesce(props, '')) AS cache_key FROM events")
def period_and_cache_keys(spark, sf):
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM").alias("month"), F.date_format("ts", "yyyy-MM-dd").alias("day"), rc.cache_key(F.col("event_type"), F.col("user_id"), F.col("props")).alias("cache_key"))


@register("SELECT p_partkey, p_size % 10 > 4 OR (p_size % 10 = 4 AND p_partkey % 7 > 2) AS newer FROM part")
def version_newer(spark, sf):
    v = F.concat(F.lit("v"), F.col("p_size") % 10, F.lit("."), F.col("p_partkey") % 7)
    return table(spark, sf, "part").select("p_partkey", rc.newer(v, F.lit("4.2")).alias("newer"))


@register("SELECT a.page_id, a.seq, CASE WHEN a.conf_pct >= 75 OR b.seq IS NULL THEN a.seq WHEN b.conf_pct > a.conf_pct THEN b.seq ELSE a.seq END AS chosen FROM lines_v a LEFT JOIN lines_v b ON a.page_id = b.page_id AND b.seq = a.seq + 1")
def reread_selection(spark, sf):
    a = view(spark, sf, "lines_v").select("page_id", "seq", "conf_pct")
    b = a.select("page_id", (F.col("seq") - 1).alias("seq"), F.col("seq").alias("other"), F.col("conf_pct").alias("other_conf"))
    return a.join(b, ["page_id", "seq"], "left").select("page_id", "seq", rc.reread(F.col("seq"), F.col("conf_pct"), F.col("other"), F.col("other_conf"), 75).alias("chosen"))


@register("""SELECT event_id, CASE WHEN rect AND NOT tail THEN 'narrator' WHEN off THEN event_type WHEN event_type IN ('click', 'view') AND event_type <> 'view' THEN event_type WHEN value >= 50 THEN 'near' END AS speaker,
  CASE WHEN rect AND NOT tail THEN 95 WHEN off THEN 90 WHEN event_type = 'click' THEN 92 WHEN value >= 50 THEN 50 ELSE 0 END AS confidence
FROM (SELECT event_id, event_type, value, event_id % 3 = 0 AS rect, event_id % 2 = 0 AS tail, event_id % 11 = 0 AS off FROM events)""")
def speaker_decision(spark, sf):
    x = table(spark, sf, "events")
    near = F.when(F.col("value") >= 50, 0.5).otherwise(0.0)
    s = rc.speaker(F.when(F.col("event_id") % 3 == 0, "rectangle").otherwise("oval"), F.col("event_id") % 2 == 0, F.col("event_id") % 11 == 0, F.col("event_type"), ["click", "view"], ["view"], F.lit("near"), near)
    return x.select("event_id", s.alias("s")).select("event_id", "s.*")


@register("SELECT page_id, seq, row_number() OVER (PARTITION BY page_id ORDER BY z, y0, seq) AS place FROM (SELECT *, seq % 3 AS z FROM lines_v) WHERE seq % 4 <> 0 AND seq % 5 <> 0")
def layer_visibility(spark, sf):
    x = view(spark, sf, "lines_v").withColumns({"z_order": F.col("seq") % 3, "active": F.lit(True), "printable": F.col("seq") % 4 != 0, "hidden": F.col("seq") % 5 == 0})
    return rc.visible(x).select("page_id", "seq", "place")


@register("SELECT page_id, seq, CASE WHEN x1 > 550 + 50 THEN 'right' ELSE 'bottom' END AS why FROM lines_v WHERE x1 > 600 OR y1 > 330 + 50")
def bounds_anomalies(spark, sf):
    return rc.anomalies(view(spark, sf, "lines_v"), 550, 330).select("page_id", "seq", "why")


@register("SELECT page_id, bubble_id, CASE WHEN bubble_id % 2 = 0 THEN target_text ELSE source_text END AS base FROM turn_pairs_v")
def base_text_fallback(spark, sf):
    x = view(spark, sf, "turn_pairs_v")
    return x.select("page_id", "bubble_id", rc.first_text(F.when(F.col("bubble_id") % 2 == 0, F.col("target_text")).otherwise(" "), F.col("source_text")).alias("base"))


@register("SELECT page_id, avg(conf_pct) AS mean_conf, CASE WHEN avg(conf_pct) < 75 THEN 'second_reader' ELSE 'done' END AS route FROM lines_v GROUP BY 1")
def confidence_routing(spark, sf):
    return rc.routed(view(spark, sf, "lines_v"), 75)


@register("SELECT user_id, event_id, value, value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS delta FROM events")
def step_deltas(spark, sf):
    return rc.deltas(table(spark, sf, "events"), "user_id", "event_id", "value")


@register("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, value FROM events), q AS (SELECT user_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM e GROUP BY 1),
h AS (SELECT e.*, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS g FROM e JOIN q USING (user_id) WHERE value > q3 + CAST(0.2 AS DOUBLE) * (q3 - q1))
SELECT user_id, min(pos) AS "start", max(pos) AS "end", max(value) AS peak FROM h GROUP BY user_id, g""")
def outlier_runs(spark, sf):
    e = table(spark, sf, "events").select("user_id", "value", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("pos"))
    return rc.outlier_runs(e, "user_id", "pos", "value", 0.2)


@register("""WITH c AS (SELECT conv_id, turn, unnest(range(1, len(ps) + 1)) AS i, unnest(list_transform(ps, lambda x: length(x))) AS size FROM (SELECT conv_id, turn, regexp_split_to_array(text, '[,.]') AS ps FROM conversations)),
r AS (SELECT conv_id, turn, i, abs(1000 * sum(size) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS UNBOUNDED PRECEDING) - 417 * sum(size) OVER (PARTITION BY conv_id, turn)) AS off FROM c)
SELECT conv_id, turn, CAST(i AS INT) AS n_first FROM r QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY off, i) = 1""")
def clause_split(spark, sf):
    x = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "[,.]")).alias("p", "body"))
    return rc.clause_split(x.select("conv_id", "turn", (F.col("p") + 1).alias("i"), F.length("body").cast("long").alias("size")), ["conv_id", "turn"], 0.4171)


@register("""WITH s AS (SELECT page_id, seq AS pos, CAST(conf_pct AS INT) AS score FROM lines_v), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS r FROM s),
b AS (SELECT *, max(CASE WHEN r = 1 THEN pos END) OVER (PARTITION BY page_id) AS best FROM r WHERE r <= 2) SELECT page_id, pos, score, r FROM b WHERE r = 1 OR (score >= 90 AND abs(pos - best) >= 2)""")
def top_two_places(spark, sf):
    return rc.top_two(view(spark, sf, "lines_v").select("page_id", F.col("seq").alias("pos"), F.col("conf_pct").alias("score")), ["page_id"], 90, 2)


RULES = [("articles", "(the|der|le|el) "), ("doubled", "[a-z]{12,}"), ("numbers", "[0-9]+"), ("lines", "\\n")]


@register(" UNION ALL ".join(f"SELECT '{n}' AS rule, sum(CASE WHEN regexp_matches(text, '{p}') THEN 1 ELSE 0 END) AS hits, count(*) AS all_texts FROM documents" for n, p in RULES))
def rule_coverage(spark, sf):
    return rc.rule_hits(table(spark, sf, "documents"), RULES)


@register(CLUSTER_SQL + """, n AS (SELECT page_id, cluster, side, lobe, min(seq) AS head, count(*) AS size FROM lobes GROUP BY ALL)
SELECT l.page_id, l.seq, n.head, n.size, row_number() OVER (PARTITION BY l.page_id, l.cluster, l.side, l.lobe ORDER BY l.seq) AS lobe_index FROM lobes l JOIN n ON l.page_id = n.page_id AND l.cluster = n.cluster AND l.side = n.side AND l.lobe = n.lobe""")
def cluster_join_back(spark, sf):
    key = ["page_id", "cluster", "side", "lobe"]
    over = Window.partitionBy(*key).orderBy("seq")
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in the order of the numbers, so rows are sorted once
    x = ln.cluster_lines(view(spark, sf, "lines_v"))
    return x.select("page_id", "seq", F.min("seq").over(whole).alias("head"), F.count("*").over(whole).alias("size"), F.row_number().over(over).alias("lobe_index"))


@register("SELECT event_type, count(*) AS entries, count(DISTINCT props) AS keys, sum(length(coalesce(props, ''))) AS size FROM events GROUP BY 1")
def cache_stats(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("entries"), F.count_distinct("props").alias("keys"), F.sum(F.length(F.coalesce("props", F.lit("")))).alias("size"))


@register("""SELECT p_brand, count(*) AS n, sum(len(string_split(p_name, ' '))) AS words, max(len(string_split(p_name, ' '))) AS longest FROM part GROUP BY 1""")
def profile_list_sizes(spark, sf):
    words = F.size(F.split("p_name", " ")).cast("long")
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.sum(words).alias("words"), F.max(words).alias("longest"))


@register("SELECT role, count(*) AS n, string_agg(conv_id || ':' || turn, ',' ORDER BY conv_id, turn) AS turns FROM conversations GROUP BY 1")
def pairs_by_speaker(spark, sf):
    # the turns of one role, as the store keeps them with its profile
    key = F.array_sort(F.collect_list(F.struct("conv_id", "turn")))
    x = table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n"), key.alias("k"))
    return x.select("role", "n", F.array_join(F.transform("k", lambda s: F.concat(s["conv_id"], F.lit(":"), s["turn"])), ",").alias("turns"))


@register()
def dominant_colours(spark, sf):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = table(spark, sf, "embeddings").select("label", array_to_vector(F.slice("embedding", 1, 3).cast("array<double>")).alias("features"))
    found = KMeans(k=3, maxIter=20, seed=1).fit(x).transform(x)
    share = F.count("*") / F.sum(F.count("*")).over(Window.partitionBy("label"))
    return found.groupBy("label", "prediction").agg(F.count("*").alias("n"), share.alias("weight"))


@register()
def near_titles(spark, sf):
    x = view(spark, sf, "turn_pairs_v")
    return x.select("page_id", "bubble_id", sequence_ratio("source_text", "target_text").alias("ratio"))
