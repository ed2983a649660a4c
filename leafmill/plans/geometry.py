"""Queries over the page views: lines, rectangles, panels, matching, order."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import geometry as geo
from leafmill.operators import lines as ln
from leafmill.operators import matching as mt
from leafmill.operators import order as od
from leafmill.plans.registry import register
from leafmill.sources.tables import table, view

PAIRS_SQL = """p AS (SELECT a.page_id, a.seq AS a_seq, b.seq AS b_seq,
    greatest(0, greatest(a.x0, b.x0) - least(a.x1, b.x1)) AS gap_x, greatest(0, greatest(a.y0, b.y0) - least(a.y1, b.y1)) AS gap_y,
    abs(a.x0 + a.x1 - b.x0 - b.x1) AS c_dist2, greatest(a.x1 - a.x0, b.x1 - b.x0) AS wider
  FROM lines_v a JOIN lines_v b ON a.page_id = b.page_id AND a.seq < b.seq),
pairs AS (SELECT page_id, a_seq, b_seq, gap_x, gap_y, c_dist2, centred AND gap_x > 0 AS diamond
  FROM (SELECT *, c_dist2 <= greatest(wider * CAST(0.65 AS DOUBLE), 60) AS centred FROM p)
  WHERE gap_y <= 40 AND (centred OR (gap_x <= 12 AND NOT (gap_x > 15 AND gap_y > 15))))"""


@register(f"WITH {PAIRS_SQL} SELECT * FROM pairs")
def line_pairs(spark, sf):
    return ln.line_pairs(view(spark, sf, "lines_v"))


@register(f"""WITH {PAIRS_SQL} SELECT l.page_id, l.n_lines, coalesce(q.n_pairs, 0) AS n_pairs, coalesce(q.n_diamond_only, 0) AS n_diamond_only
FROM (SELECT page_id, count(*) AS n_lines FROM lines_v GROUP BY 1) l LEFT JOIN
(SELECT page_id, count(*) AS n_pairs, count(*) FILTER (WHERE diamond) AS n_diamond_only FROM pairs GROUP BY 1) q USING (page_id)""")
def line_pair_report(spark, sf):
    return ln.pair_report(view(spark, sf, "lines_v"))


COMPONENTS_SQL = f"""{PAIRS_SQL},
e AS (SELECT page_id, a_seq AS a, b_seq AS b FROM pairs UNION SELECT page_id, b_seq, a_seq FROM pairs),
walk AS (SELECT page_id, seq, seq AS reached FROM lines_v UNION SELECT w.page_id, w.seq, e.b FROM walk w JOIN e ON e.page_id = w.page_id AND e.a = w.reached),
comp AS (SELECT page_id, seq, min(reached) AS cluster FROM walk GROUP BY page_id, seq)"""


@register(f"WITH RECURSIVE {COMPONENTS_SQL} SELECT * FROM comp")
def connected_components(spark, sf):
    lines = view(spark, sf, "lines_v")
    return ln.page_components(lines, ln.line_pairs(lines))


SIDES_SQL = """
s0 AS (SELECT *, max(x1) OVER (PARTITION BY {key} ORDER BY x0, seq ROWS UNBOUNDED PRECEDING) AS e, lead(x0) OVER (PARTITION BY {key} ORDER BY x0, seq) AS nx FROM {source}),
s1 AS (SELECT *, CAST(floor((e + nx) / 2) AS INT) AS mid, row_number() OVER (PARTITION BY {key} ORDER BY CASE WHEN nx - e >= 12 THEN nx - e END DESC NULLS LAST, e) AS r, nx - e AS free FROM s0),
s2 AS (SELECT *, max(CASE WHEN r = 1 AND free >= 12 THEN mid END) OVER (PARTITION BY {key}) AS split_x FROM s1),
s3 AS (SELECT *, count(*) OVER (PARTITION BY {key}) AS n, sum(CASE WHEN x1 <= split_x + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY {key}) AS nl,
  sum(CASE WHEN x0 >= split_x - 5 THEN 1 ELSE 0 END) OVER (PARTITION BY {key}) AS nr FROM s2),
sides AS (SELECT *, CASE WHEN coalesce(nl + nr = n AND nl > 0 AND nr > 0, false) AND x0 >= split_x - 5 THEN 1 ELSE 0 END AS side FROM s3)"""


@register("WITH " + SIDES_SQL.format(key="page_id", source="lines_v").strip() + " SELECT page_id, seq, split_x, side FROM sides")
def max_gap_split(spark, sf):
    return ln.split_columns(view(spark, sf, "lines_v"), ["page_id"]).select("page_id", "seq", F.col("split_x").cast("int").alias("split_x"), "side")


LOBES_SQL = """
v0 AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY y0, seq) AS k, count(*) OVER (PARTITION BY {key}) AS cnt, lead(y0) OVER (PARTITION BY {key} ORDER BY y0, seq) - y1 AS v_gap,
  max(y1) OVER (PARTITION BY {key}) - min(y0) OVER (PARTITION BY {key}) AS h, max(x1) OVER (PARTITION BY {key}) - min(x0) OVER (PARTITION BY {key}) AS w FROM {source}),
v1 AS (SELECT *, min(CASE WHEN h >= CAST(1.1 AS DOUBLE) * w AND h >= 130 AND v_gap >= 25 AND k >= 2 AND k < cnt THEN k END) OVER (PARTITION BY {key}) AS tall_at,
  row_number() OVER (PARTITION BY {key} ORDER BY CASE WHEN k >= 2 AND k < cnt AND v_gap >= 28 THEN v_gap END DESC NULLS LAST, k) AS gr FROM v0),
v2 AS (SELECT *, max(CASE WHEN gr = 1 AND k >= 2 AND k < cnt AND v_gap >= 28 THEN k END) OVER (PARTITION BY {key}) AS gap_at FROM v1),
lobes AS (SELECT *, CASE WHEN cnt >= 4 AND k > coalesce(tall_at, gap_at) THEN 1 ELSE 0 END AS lobe FROM v2)"""


@register("WITH " + LOBES_SQL.format(key="page_id", source="lines_v").strip() + " SELECT page_id, seq, lobe FROM lobes")
def vertical_gap_split(spark, sf):
    return ln.split_stacked(view(spark, sf, "lines_v"), ["page_id"]).select("page_id", "seq", "lobe")


CLUSTER_SQL = f"""WITH RECURSIVE {COMPONENTS_SQL}, src AS (SELECT l.*, c.cluster FROM lines_v l JOIN comp c USING (page_id, seq)),
{SIDES_SQL.format(key="page_id, cluster", source="src").strip()},
parted AS (SELECT page_id, seq, x0, y0, x1, y1, conf_pct, cluster, side FROM sides),
{LOBES_SQL.format(key="page_id, cluster, side", source="parted").strip()}"""


@register(CLUSTER_SQL + " SELECT page_id, seq, cluster, side, lobe FROM lobes")
def cluster_lines(spark, sf):
    return ln.cluster_lines(view(spark, sf, "lines_v")).select("page_id", "seq", "cluster", "side", "lobe")


@register(CLUSTER_SQL + """ SELECT page_id, cluster, side, lobe, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_lines, avg(conf_pct) AS mean_conf,
  string_agg(CAST(seq AS VARCHAR), ',' ORDER BY y0, x0, seq) AS members, median(y1 - y0) AS median_height FROM lobes GROUP BY page_id, cluster, side, lobe""")
def cluster_envelope(spark, sf):
    return ln.envelopes(ln.cluster_lines(view(spark, sf, "lines_v")), ["page_id", "cluster", "side", "lobe"])


@register("""SELECT page_id, seq, x0, y0, coalesce(CASE WHEN seq % 3 > 0 THEN x1 END, x0 + 100) AS x1, coalesce(CASE WHEN seq % 3 > 0 THEN y1 END, y0 + 30) AS y1,
  CAST(trunc(x0 / 1000.0 * 850) AS INT) AS px, (x0 + coalesce(CASE WHEN seq % 3 > 0 THEN x1 END, x0 + 100)) // 2 AS cx FROM lines_v""")
def bbox_normalize(spark, sf):
    x = view(spark, sf, "lines_v").withColumns({c: F.when(F.col("seq") % 3 > 0, F.col(c)) for c in ("x1", "y1")})
    b = geo.coerced()
    return x.select("page_id", "seq", "x0", "y0", b.x1.alias("x1"), b.y1.alias("y1"), geo.scaled(F.col("x0"), F.lit(850)).alias("px"), F.floor((b.x0 + b.x1) / 2).cast("int").alias("cx"))


@register("""SELECT page_id, seq, CASE WHEN 1000 * abs(dy) <= 414 * abs(dx) THEN we WHEN 1000 * abs(dx) <= 414 * abs(dy) THEN ns ELSE ns || '-' || we END AS label FROM
(SELECT page_id, seq, x0 - 300 AS dx, y0 - 200 AS dy, CASE WHEN y0 < 200 THEN 'top' ELSE 'bottom' END AS ns, CASE WHEN x0 < 300 THEN 'left' ELSE 'right' END AS we FROM lines_v)""")
def angle_direction_label(spark, sf):
    return view(spark, sf, "lines_v").select("page_id", "seq", geo.direction(F.col("x0") - 300, F.col("y0") - 200).alias("label"))


@register("""SELECT page_id, seq, panel_idx, (x1 - px1 > -10) OR (px0 - x0 > -10) OR ((px1 - x1 < 45) AND x1 - x0 > 150) AS off_panel FROM lines_v, panels_v WHERE panel_idx = 1 + (page_id % 4)""")
def off_panel_flag(spark, sf):
    lines = view(spark, sf, "lines_v").withColumn("panel_idx", (1 + F.col("page_id") % 4).cast("int"))
    x = lines.join(F.broadcast(view(spark, sf, "panels_v")), "panel_idx")  # four rows
    past = (F.col("x1") - F.col("px1") > -10) | (F.col("px0") - F.col("x0") > -10)
    return x.select("page_id", "seq", "panel_idx", (past | ((F.col("px1") - F.col("x1") < 45) & (F.col("x1") - F.col("x0") > 150))).alias("off_panel"))


@register("""SELECT page_id, seq, r AS row_no, (x1 - x0) * CAST(0.9 AS DOUBLE) * sqrt(greatest(CAST(0.12 AS DOUBLE), 1 - n * n)) AS width FROM
(SELECT *, least(CAST(1.0 AS DOUBLE), abs(CAST(r AS DOUBLE) - 2) * 8 / greatest(1, 16)) AS n FROM (SELECT *, unnest(range(0, 5)) AS r FROM lines_v))""")
def diamond_row_widths(spark, sf):
    x = view(spark, sf, "lines_v").withColumn("row_no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    return x.select("page_id", "seq", "row_no", geo.chord_width((F.col("row_no") - 2) * 8.0, F.lit(16), F.col("x1") - F.col("x0")).alias("width"))


INTER = "greatest(0, least(l.x1, r.x1) - greatest(l.x0, r.x0)) * greatest(0, least(l.y1, r.y1) - greatest(l.y0, r.y0))"
CLAIM_SQL = f"claims AS (SELECT l.page_id, l.seq, min(rect_idx) AS rect_idx FROM lines_v l JOIN rects_v r ON l.page_id = r.page_id WHERE {INTER} >= CAST(0.5 AS DOUBLE) * greatest(1, (l.x1 - l.x0) * (l.y1 - l.y0)) GROUP BY 1, 2)"


@register(f"WITH {CLAIM_SQL} SELECT * FROM claims")
def line_to_rect_claim(spark, sf):
    return mt.claim_lines(view(spark, sf, "lines_v"), view(spark, sf, "rects_v"))


GAPS = "greatest(0, greatest(l.x0, r.x0) - least(l.x1, r.x1)) AS gx, greatest(0, greatest(l.y0, r.y0) - least(l.y1, r.y1)) AS gy"


@register(f"""WITH {CLAIM_SQL}, m AS (SELECT l.page_id, l.seq, rect_idx, {GAPS} FROM lines_v l JOIN rects_v r ON l.page_id = r.page_id WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.page_id = l.page_id AND c.seq = l.seq))
SELECT page_id, seq, rect_idx, CAST(gx * gx + gy * gy AS BIGINT) AS square_distance FROM m WHERE gx * gx + gy * gy <= 1600
QUALIFY row_number() OVER (PARTITION BY page_id, seq ORDER BY gx * gx + gy * gy, rect_idx) = 1""")
def nearest_rect_band(spark, sf):
    return mt.nearest_rect(view(spark, sf, "lines_v"), view(spark, sf, "rects_v"))


PANEL_SQL = """placed AS (SELECT l.*, panel_idx FROM lines_v l, panels_v QUALIFY row_number() OVER (PARTITION BY page_id, seq ORDER BY
  CASE WHEN x0 + x1 BETWEEN 2 * px0 AND 2 * px1 AND y0 + y1 BETWEEN 2 * py0 AND 2 * py1 THEN 0 ELSE 1 END,
  CASE WHEN x0 + x1 BETWEEN 2 * px0 AND 2 * px1 AND y0 + y1 BETWEEN 2 * py0 AND 2 * py1 THEN 0 ELSE (px0 + px1 - x0 - x1) ** 2 + (py0 + py1 - y0 - y1) ** 2 END, panel_idx) = 1)"""


@register(f"WITH {PANEL_SQL} SELECT page_id, seq, panel_idx FROM placed")
def bubble_to_panel(spark, sf):
    return od.assign_panels(view(spark, sf, "lines_v").select("page_id", "seq", "x0", "y0", "x1", "y1"), view(spark, sf, "panels_v")).select("page_id", "seq", "panel_idx")


@register(f"""WITH {PANEL_SQL} SELECT panel_idx, count(*) AS n_bubbles, count(DISTINCT page_id) AS n_pages FROM placed GROUP BY 1""")
def panel_counts(spark, sf):
    boxed = od.assign_panels(view(spark, sf, "lines_v").select("page_id", "seq", "x0", "y0", "x1", "y1"), view(spark, sf, "panels_v"))
    return boxed.groupBy("panel_idx").agg(F.count("*").alias("n_bubbles"), F.count_distinct("page_id").alias("n_pages"))


@register(f"SELECT r.* FROM rects_v r WHERE NOT EXISTS (SELECT 1 FROM lines_v l WHERE l.page_id = r.page_id AND {INTER} >= CAST(0.35 AS DOUBLE) * greatest(1, (r.x1 - r.x0) * (r.y1 - r.y0)))")
def uncovered_candidates(spark, sf):
    return mt.uncovered(view(spark, sf, "rects_v"), view(spark, sf, "lines_v"))


@register(f"""SELECT page_id, seq FROM lines_v l WHERE EXISTS (SELECT 1 FROM (SELECT r.*, {GAPS},
  greatest(0, least(l.x1, r.x1) - greatest(l.x0, r.x0)) AS ox, greatest(0, least(l.y1, r.y1) - greatest(l.y0, r.y0)) AS oy FROM lines_v r WHERE r.page_id = l.page_id AND r.seq <> l.seq) r
  WHERE (gy <= 35 AND ox >= CAST(0.35 AS DOUBLE) * greatest(1, least(l.x1 - l.x0, r.x1 - r.x0))) OR (gx <= 35 AND oy >= CAST(0.35 AS DOUBLE) * greatest(1, least(l.y1 - l.y0, r.y1 - r.y0))))""")
def adjacent_exists(spark, sf):
    return mt.adjacent(view(spark, sf, "lines_v"))


@register(f"""WITH b AS (SELECT r.page_id, rect_idx, l.seq, {INTER} AS inter, greatest(1, (l.x1 - l.x0) * (l.y1 - l.y0)) AS ca, greatest(1, (r.x1 - r.x0) * (r.y1 - r.y0)) AS ga,
  abs(r.x0 + r.x1 - l.x0 - l.x1) AS ddx, 2 * greatest(1, r.x1 - r.x0, l.x1 - l.x0) AS sx, abs(r.y0 + r.y1 - l.y0 - l.y1) AS ddy, 2 * greatest(1, r.y1 - r.y0, l.y1 - l.y0) AS sy,
  greatest(0, least(l.x1, r.x1) - greatest(l.x0, r.x0)) AS ox, greatest(1, least(l.x1 - l.x0, r.x1 - r.x0)) AS mw, greatest(0, greatest(l.y0, r.y0) - least(l.y1, r.y1)) AS v_gap
  FROM lines_v l JOIN rects_v r ON l.page_id = r.page_id),
m AS (SELECT page_id, rect_idx, seq, inter, v_gap, 1000000 * CAST(inter AS BIGINT) // (ca + ga - inter) AS iou, 1000000 * CAST(inter AS BIGINT) // ca AS of_c, 1000000 * CAST(inter AS BIGINT) // ga AS of_g,
  1000000 * CAST(least(ca, ga) AS BIGINT) // greatest(ca, ga) AS ratio, 1000000 * CAST(ddx AS BIGINT) // sx AS dx, 1000000 * CAST(ddy AS BIGINT) // sy AS dy, 1000000 * CAST(ox AS BIGINT) // mw AS wide FROM b),
c AS (SELECT page_id, rect_idx, seq, 1 AS phase, 5 * iou + 3 * of_c + 2 * of_g + 2 * ratio - dx - dy AS score FROM m
  WHERE inter > 0 AND (iou >= 400000 OR of_c >= 350000 OR of_g >= 350000) AND dx < 400000 AND dy < CASE WHEN dx < 200000 THEN 500000 ELSE 350000 END
  UNION ALL SELECT page_id, rect_idx, seq, 2, 2 * wide - 20000 * v_gap FROM m WHERE wide >= 500000 AND v_gap <= 100 AND ratio >= 250000)
SELECT page_id, rect_idx, seq, CAST(score AS BIGINT) AS score, phase FROM c WHERE score > CASE phase WHEN 1 THEN -2000000 ELSE -1000000 END
QUALIFY row_number() OVER (PARTITION BY page_id, rect_idx ORDER BY phase, score DESC, seq) = 1""")
def best_match_score(spark, sf):
    return mt.best_match(view(spark, sf, "rects_v"), view(spark, sf, "lines_v"))


@register("""WITH a AS (SELECT * FROM lines_v WHERE seq % 2 = 0), b AS (SELECT * FROM lines_v WHERE seq % 2 = 1)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.page_id = b.page_id AND abs(a.x0 + a.x1 - b.x0 - b.x1) < 50 AND abs(a.y0 + a.y1 - b.y0 - b.y1) < 36)""")
def seam_dedupe(spark, sf):
    lines = view(spark, sf, "lines_v")
    return mt.seam_dedupe(lines.where("seq % 2 = 0"), lines.where("seq % 2 = 1"))


@register("""WITH q AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), s AS (SELECT min(id) AS name FROM (SELECT vec_id AS id, label FROM embeddings) GROUP BY label),
k AS (SELECT name, v AS s FROM s JOIN q ON id = name)
SELECT id, name FROM q, k QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_sum(list_transform(range(1, 65), lambda i: (v[i] - s[i]) ** 2)), name) = 1""")
def signature_nearest(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    known = e.groupBy("label").agg(F.min(F.struct("id", "v")).alias("m")).select(F.col("m.id").alias("name"), "m.v")
    return mt.nearest_signature(e.select("id", "v"), known, least=-1e9).select("id", "name")


def _meets(a: str, b: str) -> dict[str, str]:
    inter = f"(greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)))"
    return {"inter": inter, "area_a": f"(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0))", "area_b": f"(({b}.x1 - {b}.x0) * ({b}.y1 - {b}.y0))"}


_m = _meets("a", "x[1]")
BOX = "'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1"


@register(f"""WITH g AS (SELECT page_id, list([{{'seq': seq, {BOX}, 'k': seq % 3}}] ORDER BY conf_pct DESC, seq) AS xs FROM lines_v GROUP BY page_id),
r AS (SELECT page_id, xs, list_reduce(xs, lambda kept, x: CASE WHEN len(list_filter(kept, lambda a: {_m['inter']} > 0
  AND (100 * {_m['inter']} >= 40 * ({_m['area_a']} + {_m['area_b']} - {_m['inter']}) OR 100 * {_m['inter']} >= 65 * greatest(1, {_m['area_b']}) OR 100 * {_m['inter']} >= 65 * greatest(1, {_m['area_a']}))
  AND NOT (a.k <> x[1].k AND 100 * {_m['inter']} < 88 * greatest(1, {_m['area_b']}) AND 100 * {_m['inter']} < 88 * greatest(1, {_m['area_a']})))) > 0 THEN kept ELSE list_concat(kept, x) END) AS kept FROM g)
SELECT page_id, x[1].seq AS seq, list_contains(list_transform(kept, lambda k: k.seq), x[1].seq) AS kept FROM (SELECT page_id, kept, unnest(xs) AS x FROM r)""")
def nms_dedupe(spark, sf):
    lines = view(spark, sf, "lines_v")
    return mt.suppress(lines.withColumn("score", F.col("conf_pct")).withColumn("text_key", F.concat(F.lit("t"), F.col("seq") % 3)))


@register(f"""WITH g AS (SELECT page_id, list([{{'seq': seq, {BOX}}}] ORDER BY (x1 - x0) * (y1 - y0) DESC, seq) AS xs FROM lines_v GROUP BY page_id),
r AS (SELECT page_id, xs, list_reduce(xs, lambda kept, x: CASE WHEN len(list_filter(kept, lambda a: 100 * {_m['inter']} > 75 * {_m['area_b']})) > 0 THEN kept ELSE list_concat(kept, x) END) AS kept FROM g)
SELECT page_id, x[1].seq AS seq, list_contains(list_transform(kept, lambda k: k.seq), x[1].seq) AS kept FROM (SELECT page_id, kept, unnest(xs) AS x FROM r)""")
def panel_dedupe(spark, sf):
    return mt.outer_panels(view(spark, sf, "lines_v"))


_OVER = f"100 * {_m['inter']} > 40 * greatest(1, {_m['area_a']} + {_m['area_b']} - {_m['inter']})"
_AT = f"coalesce(list_position(list_transform(out, lambda a: {_OVER}), true), 0)"


@register(f"""WITH g AS (SELECT page_id, list([{{'second': seq % 2 <> 0, {BOX}}}] ORDER BY seq % 2, seq) AS xs FROM lines_v GROUP BY page_id),
r AS (SELECT page_id, list_reduce(xs, lambda out, x: CASE WHEN x[1].second AND {_AT} > 0 THEN list_transform(out, lambda o, i: CASE WHEN i = {_AT}
  THEN {{'second': o.second, 'x0': least(o.x0, x[1].x0), 'y0': least(o.y0, x[1].y0), 'x1': greatest(o.x1, x[1].x1), 'y1': greatest(o.y1, x[1].y1)}} ELSE o END) ELSE list_concat(out, x) END) AS out FROM g)
SELECT page_id, o.x0 AS x0, o.y0 AS y0, o.x1 AS x1, o.y1 AS y1 FROM (SELECT page_id, unnest(out) AS o FROM r)""")
def envelope_merge(spark, sf):
    lines = view(spark, sf, "lines_v")
    return mt.merge_envelopes(lines.withColumn("pass", F.when(F.col("seq") % 2 == 0, 1).otherwise(2)))


def _reading_sql(items: str, key: str) -> str:
    """Rows by overlap in height, the pull-up to its fixpoint, then places: as recursive SQL over ``items``."""
    span, over = "least(w.b - w.t, x[1].b - x[1].t)", "greatest(0, least(w.b, x[1].b) - greatest(w.t, x[1].t))"
    home = f"coalesce(list_position(list_transform(rows, lambda w: {span} > 0 AND 4 * {over} >= {span}), true), 0)"
    inside = "q.x0 >= list_min(list_transform({w}.m, lambda z: z.x0)) AND q.x1 <= list_max(list_transform({w}.m, lambda z: z.x1)) AND q.y0 < {w}.b + 25"
    later = "flatten(list_transform(rows[{i} + 1:], lambda o: o.m))"
    first = f"list_position(list_transform(rows, lambda w, i: len(list_filter({later.format(i='i')}, lambda q: {inside.format(w='w')})) > 0), true)"
    pulled = f"list_filter({later.format(i='r')}, lambda q: {inside.format(w='rows[r]')})"
    return f"""g AS (SELECT {key}, list([{{'t': y0, 'b': y1, 'm': [{{'seq': seq, {BOX}}}]}}] ORDER BY y0, seq) AS xs FROM {items} GROUP BY {key}),
b AS (SELECT {key}, list_reduce(xs, lambda rows, x: CASE WHEN {home} > 0 THEN list_transform(rows, lambda w, i: CASE WHEN i = {home}
  THEN {{'t': least(w.t, x[1].t), 'b': greatest(w.b, x[1].b), 'm': list_concat(w.m, x[1].m)}} ELSE w END) ELSE list_concat(rows, x) END) AS rows FROM g),
st AS (SELECT {key}, rows FROM b UNION ALL SELECT {key}, list_filter(list_transform(rows, lambda w, i: CASE WHEN i < r THEN w WHEN i = r
  THEN {{'t': least(w.t, list_min(list_transform(ps, lambda q: q.y0))), 'b': greatest(w.b, list_max(list_transform(ps, lambda q: q.y1))), 'm': list_concat(w.m, ps)}}
  ELSE {{'t': w.t, 'b': w.b, 'm': list_filter(w.m, lambda q: NOT list_contains(list_transform(ps, lambda z: z.seq), q.seq))}} END), lambda w: len(w.m) > 0)
  FROM (SELECT *, {pulled} AS ps FROM (SELECT *, {first} AS r FROM st) WHERE r IS NOT NULL)),
e AS (SELECT {key}, unnest(rows) AS w, unnest(range(1, len(rows) + 1)) AS born FROM st WHERE {first} IS NULL),
o AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY w.t, born) AS spot, w FROM e),
i AS (SELECT {key}, spot, unnest(w.m) AS q, unnest(range(1, len(w.m) + 1)) AS k FROM o),
placed_rows AS (SELECT {key}, q.seq AS seq, CAST(row_number() OVER (PARTITION BY {key} ORDER BY spot, q.x0, q.y0, k) AS INT) AS place FROM i)"""


@register(f"WITH RECURSIVE {_reading_sql('lines_v', 'page_id')} SELECT page_id, seq, place FROM placed_rows")
def row_major_order(spark, sf):
    return od.reading_order(view(spark, sf, "lines_v"), ["page_id"])


@register(f"""WITH RECURSIVE {PANEL_SQL}, {_reading_sql('placed', 'page_id, panel_idx')}
SELECT page_id, seq, panel_idx, place, row_number() OVER (PARTITION BY page_id ORDER BY panel_idx, place) AS reading_index FROM placed_rows""")
def page_reading_order(spark, sf):
    return od.page_reading_order(view(spark, sf, "lines_v"), view(spark, sf, "panels_v"))


_FITS = "least(x[1].l[1].y1, l.y1) - greatest(x[1].l[1].y0, l.y0) > CAST(0.35 AS DOUBLE) * greatest(1, least(x[1].l[1].y1 - x[1].l[1].y0, l.y1 - l.y0)) AND x[1].l[1].x0 - l.x1 >= -15 AND x[1].l[1].x0 - l.x1 <= greatest(40, CAST(1.8 AS DOUBLE) * (x[1].l[1].y1 - x[1].l[1].y0))"
_HOME = f"coalesce(list_position(list_transform(s[1].l, lambda l: {_FITS}), true), 0)"


@register(f"""WITH g AS (SELECT page_id, list([{{'l': [{{{BOX}}}], 'o': [{{'seq': seq, 'line': 0}}]}}] ORDER BY y0, x0, seq) AS xs FROM lines_v GROUP BY page_id),
r AS (SELECT page_id, list_reduce(xs, lambda s, x: [{{'l': CASE WHEN {_HOME} > 0 THEN list_transform(s[1].l, lambda w, i: CASE WHEN i = {_HOME} THEN x[1].l[1] ELSE w END) ELSE list_concat(s[1].l, x[1].l) END,
  'o': list_concat(s[1].o, [{{'seq': x[1].o[1].seq, 'line': CAST(CASE WHEN {_HOME} > 0 THEN {_HOME} - 1 ELSE len(s[1].l) END AS INT)}}])}}]) AS s FROM g)
SELECT page_id, o.seq AS seq, o.line AS line FROM (SELECT page_id, unnest(s[1].o) AS o FROM r)""")
def words_to_lines(spark, sf):
    return ln.words_to_lines(view(spark, sf, "lines_v"))


@register("""SELECT page_id, seq, row_number() OVER w AS new_id, row_number() OVER w <> seq AS moved FROM lines_v WINDOW w AS (PARTITION BY page_id ORDER BY y0, x0, seq)""")
def renumber_reading(spark, sf):
    from pyspark.sql import Window

    new = F.row_number().over(Window.partitionBy("page_id").orderBy("y0", "x0", "seq"))
    return view(spark, sf, "lines_v").select("page_id", "seq", new.alias("new_id"), (new != F.col("seq")).alias("moved"))


@register("SELECT page_id, seq, row_number() OVER (PARTITION BY page_id ORDER BY y0 // 80, x0, seq) AS place FROM lines_v")
def banded_sort_rank(spark, sf):
    return od.banded(view(spark, sf, "lines_v"), 80).select("page_id", "seq", "place")


HOURS = "h AS (SELECT user_id, CAST(extract(hour FROM ts) AS BIGINT) AS pos FROM events GROUP BY 1, 2)"
RUNS = f"{HOURS}, i AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS g FROM h), runs AS (SELECT user_id, min(pos) AS s, max(pos) + 1 AS e FROM i GROUP BY user_id, g HAVING max(pos) + 1 - min(pos) >= 2)"


def _hour_mask(spark, sf):
    return table(spark, sf, "events").select("user_id", F.hour("ts").cast("long").alias("pos")).distinct().withColumn("on", F.lit(True))


@register(f'WITH {RUNS} SELECT user_id, s AS "start", e AS "end" FROM runs')
def gutter_runs(spark, sf):
    return od.mask_runs(_hour_mask(spark, sf), ["user_id"], 2)


@register(f"""WITH {RUNS}, p AS (SELECT user_id, s, e FROM runs UNION ALL SELECT DISTINCT user_id, 24, NULL FROM runs)
SELECT user_id, seg_start, seg_end FROM (SELECT user_id, coalesce(lag(e) OVER (PARTITION BY user_id ORDER BY s, e NULLS LAST), 0) AS seg_start, s AS seg_end FROM p) WHERE seg_end - seg_start >= 2""")
def content_segments(spark, sf):
    return od.content_segments(od.mask_runs(_hour_mask(spark, sf), ["user_id"], 2), ["user_id"], 24, 2)


@register("""SELECT page_id, count(*) AS n, sum(CASE WHEN inside THEN 1 ELSE 0 END) AS n_inside FROM
(SELECT l.page_id, (l.x0 + l.x1) / 2.0 BETWEEN r.x0 AND r.x1 AND (l.y0 + l.y1) / 2.0 BETWEEN r.y0 AND r.y1 AS inside FROM lines_v l JOIN rects_v r ON l.page_id = r.page_id) GROUP BY 1""")
def polygon_members(spark, sf):
    r = view(spark, sf, "rects_v").select("page_id", *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    x = view(spark, sf, "lines_v").join(r, "page_id")
    point = lambda a, b: F.array(F.col(a), F.col(b))
    ring = F.array(point("r_x0", "r_y0"), point("r_x1", "r_y0"), point("r_x1", "r_y1"), point("r_x0", "r_y1"))
    inside = geo.in_polygon(ring, (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2)
    return x.groupBy("page_id").agg(F.count("*").alias("n"), F.count_if(inside).alias("n_inside"))
