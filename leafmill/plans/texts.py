"""Queries over text, terms, events and keyed state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.functions import emphasis as em
from leafmill.functions import lettering, similarity
from leafmill.functions import sounds as sd
from leafmill.functions import text as tx
from leafmill.operators import lexicon as lx
from leafmill.operators import quality as qa
from leafmill.operators import state as st
from leafmill.plans.registry import register
from leafmill.session import bounded
from leafmill.sources.tables import table, view

# ---- scans and sinks ----


@register("SELECT seq, page_id, pattern_name, severity, value FROM gate_events_v WHERE page_id = 7 ORDER BY ts, seq")
def scan_events_by_page_ordered(spark, sf):
    return view(spark, sf, "gate_events_v").where("page_id = 7").orderBy("ts", "seq").select("seq", "page_id", "pattern_name", "severity", "value")


@register("SELECT page_id, seq, pattern_name, severity, value FROM gate_events_v QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ts DESC, seq DESC) = 1")
def upsert_latest_by_key(spark, sf):
    return st.latest(view(spark, sf, "gate_events_v"), "page_id", ["ts", "seq"]).select("page_id", "seq", "pattern_name", "severity", "value")


@register("SELECT kind, substr(md5(string_agg(kv, '|' ORDER BY kv)), 1, 8) AS hash, count(*) AS n FROM (SELECT p_brand AS kind, p_name || ':' || p_type AS kv FROM part) GROUP BY kind")
def dictionary_hash(spark, sf):
    return lx.term_hash(table(spark, sf, "part").select(F.col("p_brand").alias("kind"), F.col("p_name").alias("k"), F.col("p_type").alias("v")))


@register("""WITH a AS (SELECT conv_id AS id, turn, text, 1 AS priority FROM conversations UNION ALL SELECT doc_id, 0, text, 2 FROM documents)
SELECT text, priority, id FROM a QUALIFY row_number() OVER (PARTITION BY text ORDER BY priority, id, turn) = 1""")
def distinct_corpus(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "turn", "text", F.lit(1).alias("priority"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), "text", F.lit(2).alias("priority"))
    best = c.unionByName(d).groupBy("text").agg(F.min(F.struct("priority", "id", "turn")).alias("m"))
    return best.select("text", "m.priority", "m.id")


# ---- predicates over text ----

SOUND_WORDS = sorted({w for ws in sd.KINDS.values() for w in ws})
WATERMARKS = ["readallcomics", "licensed under"]
VOCABULARY = "THE AND OF TO IN IT IS THAT WITH".split()
_list = lambda words: ", ".join(f"'{w}'" for w in words)
SENTENCES_SQL = "s AS (SELECT conv_id, turn, i, list_extract(ps, i) AS body FROM (SELECT conv_id, turn, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT conv_id, turn, regexp_split_to_array(text, '[.!?…]+') AS ps FROM conversations)))"


@register(f"""WITH {SENTENCES_SQL},
b AS (SELECT *, trim(body) AS t, 10 + (turn * 7 + i * 13) % 90 AS conf FROM s),
w AS (SELECT *, list_filter(list_transform(regexp_extract_all(upper(replace(t, 'ß', 'SS')), '[A-Z'']+'), lambda x: replace(x, '''', '')), lambda x: x <> '') AS ws, length(regexp_replace(t, '[^A-Za-z]+', '', 'g')) AS letters,
  length(regexp_replace(t, '[^A-Za-z0-9]+', '', 'g')) AS alnum, length(regexp_replace(t, '[A-Za-z0-9\\s]+', '', 'g')) AS symbols, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') AS tok FROM b),
c AS (SELECT *, len(list_filter(tok, lambda x: length(x) = 1)) AS single, list_filter(ws, lambda x: x IN ({_list(VOCABULARY)}, 'A', 'I') OR (conf >= 25 AND length(x) >= 2 AND length(replace(x, x[1], '')) > 0
  AND regexp_matches(x, '[AEIOUY]') AND NOT (length(x) > 6 AND 100 * length(regexp_replace(x, '[^AEIOUY]+', '', 'g')) < 12 * length(x)) AND NOT regexp_matches(x, '[B-DF-HJ-NP-TV-XZ]{{5,}}'))) AS known FROM w)
SELECT conv_id, turn, i, CASE WHEN t = '' THEN 'empty' WHEN len(ws) > 0 AND len(list_filter(ws, lambda x: x NOT IN ({_list(SOUND_WORDS)}))) = 0 THEN 'sfx' WHEN conf < 12 THEN 'low_conf'
  WHEN contains(upper(t), '{WATERMARKS[0].upper()}') OR contains(upper(t), '{WATERMARKS[1].upper()}') THEN 'watermark' WHEN letters < 2 THEN 'too few letters' WHEN alnum = 0 OR 5 * symbols > 6 * alnum THEN 'abnormal symbol ratio'
  WHEN len(tok) >= 3 AND 5 * single >= 3 * len(tok) THEN 'fragmented tokens' WHEN len(known) = 0 THEN 'no valid word' ELSE 'valid' END AS reason FROM c""")
def junk_reason(spark, sf):
    x = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", tx.SENTENCE_END)).alias("i", "body")).withColumn("i", (F.col("i") + 1).cast("long"))
    conf = (10 + (F.col("turn") * 7 + F.col("i") * 13) % 90) / 100
    return x.select("conv_id", "turn", "i", tx.junk_reason(F.col("body"), conf, SOUND_WORDS, WATERMARKS, VOCABULARY).alias("reason"))


@register()
def junk_reason_fuzzy(spark, sf):
    x = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", tx.SENTENCE_END)).alias("i", "body"))
    judge = similarity.sounding(SOUND_WORDS, VOCABULARY)
    return x.select("conv_id", "turn", (F.col("i") + 1).cast("long").alias("i"), tx.junk_reason(F.col("body"), F.lit(0.9), SOUND_WORDS, WATERMARKS, VOCABULARY, sounding=judge).alias("reason"))


@register(f"""SELECT page_id, bubble_id, t = '' OR (length(kt) >= 2 AND ks = kt) AS untranslated FROM (SELECT page_id, bubble_id, trim(coalesce(target_text, '')) AS t,
  lower(regexp_replace(coalesce(source_text, ''), '[^A-Za-z0-9]+', '', 'g')) AS ks, lower(regexp_replace(coalesce(target_text, ''), '[^A-Za-z0-9]+', '', 'g')) AS kt FROM turn_pairs_v)""")
def untranslated_flags(spark, sf):
    return view(spark, sf, "turn_pairs_v").select("page_id", "bubble_id", tx.untranslated(F.col("source_text"), F.col("target_text")).alias("untranslated"))


@register("""SELECT w, length(x) >= 2 AND length(replace(x, x[1], '')) > 0 AND regexp_matches(x, '[AEIOUY]') AND NOT (length(x) > 6 AND 100 * length(regexp_replace(x, '[^AEIOUY]+', '', 'g')) < 12 * length(x))
  AND NOT regexp_matches(x, '[B-DF-HJ-NP-TV-XZ]{5,}') AS plausible, n FROM
  (SELECT w, regexp_replace(upper(replace(w, 'ß', 'SS')), '[^A-Z]+', '', 'g') AS x, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(trim(text), '\\s+')) AS w FROM documents) GROUP BY w)""")
def phonotactic_words(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.split(F.trim("text"), "\\s+")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return words.select("w", tx.plausible_word(F.col("w")).alias("plausible"), "n")


PIECES = "len(list_filter(regexp_split_to_array({}, '[.!?…]+'), lambda x: regexp_matches(x, '\\w')))"
DROP = f"{PIECES.format('source_text')} >= 2 AND {PIECES.format('target_text')} < {PIECES.format('source_text')}"


@register(f"SELECT page_id, bubble_id, {PIECES.format('source_text')} AS n_source, {PIECES.format('target_text')} AS n_target, {DROP} AS dropped FROM turn_pairs_v")
def sentence_drop_flags(spark, sf):
    n = lambda c: F.size(tx.sentences(F.col(c))).cast("long")
    return view(spark, sf, "turn_pairs_v").select("page_id", "bubble_id", n("source_text").alias("n_source"), n("target_text").alias("n_target"), tx.drops_sentence(F.col("source_text"), F.col("target_text")).alias("dropped"))


KEY = "upper(regexp_replace(trim({}), '[^A-Za-z0-9]+', '', 'g'))"


@register(f"""SELECT page_id, bubble_id, CASE WHEN {KEY.format('source_text')} <> '' AND {KEY.format('target_text')} = '' THEN 'empty' WHEN {KEY.format('target_text')} <> '' AND {KEY.format('source_text')} = {KEY.format('target_text')} THEN 'identical'
  WHEN {DROP} THEN 'sentence_drop' END AS reason FROM turn_pairs_v""")
def validation_reason(spark, sf):
    return view(spark, sf, "turn_pairs_v").select("page_id", "bubble_id", tx.review_reason(F.col("source_text"), F.col("target_text")).alias("reason"))


@register("""SELECT seq, CASE WHEN entry_type = 'title' AND method <> 'meaning' THEN 'rule 1' WHEN entry_type = 'character_name' AND method NOT IN ('meaning', 'transliteration_override') THEN 'rule 2'
  WHEN entry_type = 'character_name' AND method = 'transliteration_override' AND trim(coalesce(reason, '')) = '' THEN 'rule 4' WHEN entry_type = 'real_person' AND method <> 'transliteration' THEN 'rule 3'
  WHEN entry_type = 'term' AND method NOT IN ('fixed', 'meaning') THEN 'rule 5' ELSE 'valid' END AS verdict FROM terms_v""")
def entry_policy_violations(spark, sf):
    return view(spark, sf, "terms_v").select("seq", lx.policy_violation(F.col("entry_type"), F.col("method"), F.col("reason")).alias("verdict"))


GROUPS = {"police": ["perimeter", "stand back"], "press": ["the of", "lead story"], "official": ["on the", "memorial"], "casual": ["no way", "in the"]}


@register("""SELECT conv_id, turn, CASE WHEN contains(lower(text), 'perimeter') OR contains(lower(text), 'stand back') THEN 'police' WHEN contains(lower(text), 'the of') OR contains(lower(text), 'lead story') THEN 'press'
  WHEN contains(lower(text), 'on the') OR contains(lower(text), 'memorial') THEN 'official' WHEN contains(lower(text), 'no way') OR contains(lower(text), 'in the') THEN 'casual' END AS archetype FROM conversations""")
def archetype_class(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.first_group(F.col("text"), GROUPS).alias("archetype"))


STIFF, ENDINGS, IDIOMS, PRONOUNS = ["the the", "of of"], ["[a-z]+tion[ .,]", "[a-z]+ing[ .,]"], ["in the", "of the"], ["it", "on", "es", "il"]


@register(f"""SELECT doc_id, 100 - {' - '.join(f"CASE WHEN regexp_matches(t, '{p}') THEN 25 ELSE 0 END" for p in STIFF)} + {' + '.join(f"CASE WHEN regexp_matches(t, '{p}') THEN 15 ELSE 0 END" for p in ENDINGS)}
  + {' + '.join(f"CASE WHEN regexp_matches(t, '{p}') THEN 10 ELSE 0 END" for p in IDIOMS)} - CASE WHEN {' OR '.join(f"regexp_matches(t, '(?s){tx.WORD_START}{p}[^\\p{{L}}\\p{{N}}_](.*[^\\p{{L}}\\p{{N}}_])?{p}{tx.WORD_END}')" for p in PRONOUNS)} THEN 20 ELSE 0 END AS score FROM (SELECT doc_id, lower(trim(text)) AS t FROM documents) WHERE t <> ''""")
def naturalness_score(spark, sf):
    d = table(spark, sf, "documents").where(F.trim("text") != "")
    return d.select("doc_id", tx.naturalness(F.col("text"), STIFF, ENDINGS, IDIOMS, PRONOUNS).alias("score"))


@register("""WITH t AS (SELECT regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_]+') AS xs FROM documents),
m AS (SELECT array_to_string(list_transform(xs, lambda x: CASE WHEN regexp_matches(x, '^[\\p{L}\\p{M}\\p{N}_]') AND NOT regexp_matches(x, '^[A-Z][a-z]+$') THEN '|' ELSE x END), '') AS t FROM t)
SELECT e AS entity, count(*) AS n FROM (SELECT unnest(regexp_extract_all(t, '[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+')) AS e FROM m) GROUP BY e""")
def entity_extract(spark, sf):
    return table(spark, sf, "documents").select(F.explode(lx.entities(F.col("text"))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))


@register("""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+')) AS ts FROM documents), b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+')) AS bs FROM benchmark),
x AS (SELECT doc_id, item_id, count(*) AS shared FROM (SELECT doc_id, unnest(ts) AS w FROM t) JOIN (SELECT item_id, unnest(bs) AS w FROM b) USING (w) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared, len(ts) + len(bs) - shared AS together FROM x JOIN t USING (doc_id) JOIN b USING (item_id)""")
def token_jaccard(spark, sf):
    d = table(spark, sf, "documents").where(F.col("text").isNotNull()).select("doc_id", tx.tokens(F.col("text")).alias("ts"))
    b = table(spark, sf, "benchmark").where(F.col("text").isNotNull()).select("item_id", tx.tokens(F.col("text")).alias("bs"))
    return lx.token_overlaps(d, b)


@register("""SELECT doc_id, length(text) > 0 AS has_text, source FROM documents WHERE regexp_matches(lower(regexp_replace(text, '[^A-Za-z0-9]+', '', 'g')), '^(the|it|on)')""")
def leak_candidates(spark, sf):
    d = table(spark, sf, "documents")
    return d.where(tx.letters_key(F.col("text")).rlike("^(the|it|on)")).select("doc_id", (F.length("text") > 0).alias("has_text"), "source")


#: Words of the corpus' own language that count as sounds, next to the dictionary: (name, kind, rank, confidence).
HOUSE_SOUNDS = [("THE", "web_speed", 1, 0.99), ("ER", "creature_vocal", 4, 0.99), ("THING", "impact_explosion", 0, 0.99), ("ED", "mechanical_tech", 2, 0.99)]
SOUND_ROWS = sd.dictionary() + HOUSE_SOUNDS


@register(f"""WITH s(name, kind, rank, sure) AS (VALUES {', '.join(f"('{n.replace("'", "''")}', '{k}', {r}, {round(c * 100)})" for n, k, r, c in SOUND_ROWS)}),
w AS (SELECT doc_id AS id, unnest(list_distinct(regexp_split_to_array(trim(text), '\\s+'))) AS word FROM documents),
d AS (SELECT word, {sd.sql_core('word')} AS core FROM (SELECT DISTINCT word FROM w)), k AS (SELECT word, core, {sd.sql_letters('core')} AS key FROM d),
f AS (SELECT word, core, key, unnest(list_distinct([core, key, {sd.sql_shortened('key', 2)}, {sd.sql_shortened('key', 1)}])) AS form FROM k WHERE key <> '' AND key NOT IN ({_list(sd.SPOKEN)})),
m AS (SELECT word, kind, rank, CASE WHEN form IN (core, key) THEN sure ELSE least(sure, 95) END AS confidence FROM f JOIN s ON form = name WHERE sure >= 99 OR form IN (core, key)),
b AS (SELECT word, kind, confidence FROM m QUALIFY row_number() OVER (PARTITION BY word ORDER BY rank, confidence DESC) = 1)
SELECT id, word, kind, confidence FROM w JOIN b USING (word)""")
def sfx_dictionary_join(spark, sf):
    words = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(F.split(F.trim("text"), "\\s+"))).alias("word"))
    return lx.sound_matches(words, spark.createDataFrame(SOUND_ROWS, "name string, kind string, rank int, sure double"))


@register("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


GLUE = ["and", "but", "of", "the", "to"]


@register(f"""SELECT conv_id, turn, prev IS NOT NULL AND (regexp_matches(trim(prev), '(\\.\\.\\.|…|-|—|,)$') OR regexp_matches(trim(text), '^[a-z]') OR lower(regexp_extract(trim(text), '^([A-Za-z'']+)', 1)) IN ({_list(GLUE)})) AS continues
FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)""")
def continuation_hint(spark, sf):
    x = table(spark, sf, "conversations").withColumn("prev", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return x.select("conv_id", "turn", tx.continues(F.col("prev"), F.col("text"), GLUE).alias("continues"))


@register("""WITH w AS (SELECT conv_id, turn, regexp_split_to_array(trim(text), '\\s+') AS ws FROM conversations), c AS (SELECT *, greatest(1, CAST(len(ws) * 5 // 12 AS BIGINT)) AS n FROM w)
SELECT conv_id, turn, array_to_string(ws[1:n], ' ') AS first, array_to_string(ws[n + 1:], ' ') AS rest FROM c""")
def lobe_chunks(spark, sf):
    ws = F.split(F.trim("text"), "\\s+")
    x = table(spark, sf, "conversations").select("conv_id", "turn", ws.alias("ws")).withColumn("n", F.greatest(F.lit(1), F.floor(F.size("ws") * 5 / 12).cast("int")))
    return x.select("conv_id", "turn", F.array_join(F.slice("ws", F.lit(1), F.col("n")), " ").alias("first"), F.array_join(F.slice("ws", F.col("n") + 1, F.size("ws")), " ").alias("rest"))


# ---- terms ----


@register("SELECT source_term, length(source_term) AS n FROM (SELECT DISTINCT source_term FROM terms_v) ORDER BY n DESC, source_term LIMIT 40")
def longest_terms_topk(spark, sf):
    return view(spark, sf, "terms_v").select("source_term").distinct().select("source_term", F.length("source_term").alias("n")).orderBy(F.desc("n"), "source_term").limit(40)


@register("SELECT source_term, 'a' AS stream FROM terms_v WHERE locked UNION ALL SELECT lower(trim(p_name)), 'b' FROM part WHERE p_size % 2 = 1")
def union_streams(spark, sf):
    a = view(spark, sf, "terms_v").where("locked").select("source_term", F.lit("a").alias("stream"))
    b = table(spark, sf, "part").where("p_size % 2 = 1").select(F.lower(F.trim("p_name")).alias("source_term"), F.lit("b").alias("stream"))
    return a.unionByName(b)


@register("""SELECT DISTINCT candidate FROM (SELECT unnest(regexp_split_to_array(p_name, ' ')) AS candidate FROM part) WHERE lower(candidate) NOT IN (SELECT split_part(source_term, ' ', 1) FROM terms_v WHERE locked)""")
def new_terms_anti(spark, sf):
    cand = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("candidate"))
    known = view(spark, sf, "terms_v").where("locked").select(F.split_part("source_term", F.lit(" "), F.lit(1)).alias("source_term")).distinct()
    return lx.new_terms(cand, known)


@register("""WITH x AS (SELECT seq, source_term, canonical, unnest(list_distinct([source_term, split_part(source_term, ' ', 1)])) AS name FROM terms_v)
SELECT seq, source_term, canonical, name, 'XNAME_' || trim(regexp_replace(upper(source_term), '[^A-Z0-9]+', '_', 'g'), '_') || '_X' AS placeholder, row_number() OVER (ORDER BY length(name) DESC, seq, name) AS place FROM x""")
def alias_expansion(spark, sf):
    t = view(spark, sf, "terms_v").withColumn("aliases", F.array(F.split_part("source_term", F.lit(" "), F.lit(1))))
    return lx.expanded_terms(t)


@register("""WITH x AS (SELECT *, min(CASE WHEN locked THEN seq END) OVER (PARTITION BY source_term) AS fl, min(seq) OVER (PARTITION BY source_term) AS first_seq, count(*) OVER (PARTITION BY source_term) AS n FROM terms_v)
SELECT source_term, canonical, entry_type, method, locked, seq, first_seq, n FROM x WHERE fl IS NULL OR seq <= fl QUALIFY row_number() OVER (PARTITION BY source_term ORDER BY seq DESC) = 1""")
def lock_fold(spark, sf):
    return st.locked_terms(view(spark, sf, "terms_v"))


@register("""WITH a AS (SELECT *, [lower(reason), entry_type] AS names FROM terms_v), x AS (SELECT *, min(CASE WHEN locked THEN seq END) OVER (PARTITION BY source_term) AS fl FROM a),
c AS (SELECT source_term, seq, canonical, unnest(names) AS name FROM x WHERE fl IS NULL OR seq <= fl)
SELECT source_term, arg_max(canonical, seq) AS canonical, string_agg(DISTINCT name, ',' ORDER BY name) AS aliases FROM c GROUP BY source_term""")
def lock_fold_aliases(spark, sf):
    t = view(spark, sf, "terms_v").withColumn("aliases", F.array_compact(F.array(F.lower("reason"), "entry_type")))
    return st.locked_terms(t).select("source_term", "canonical", F.array_join("aliases", ",").alias("aliases"))


# ---- events, quotas, audits ----


@register("SELECT pattern_name, count(*) AS n, min(seq) AS first_seq FROM gate_events_v GROUP BY 1")
def pattern_counts(spark, sf):
    return qa.pattern_counts(view(spark, sf, "gate_events_v"))


@register("""SELECT page_id, count(*) AS n_events, count(*) FILTER (WHERE severity = 'auto_fix') AS n_fixed, count(*) FILTER (WHERE severity <> 'auto_fix') AS n_flagged,
  coalesce(string_agg(DISTINCT pattern_name, ',' ORDER BY pattern_name) FILTER (WHERE severity <> 'auto_fix'), '') AS flagged FROM gate_events_v GROUP BY 1""")
def severity_split(spark, sf):
    return qa.severity_split(view(spark, sf, "gate_events_v"))


@register("""SELECT lang, count(*) AS n, 100.0 * sum(CASE WHEN quality IS NOT NULL THEN 1 ELSE 0 END) / greatest(1, count(*)) AS labelled_pct, 100.0 * sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) / greatest(1, sum(CASE WHEN quality IS NOT NULL THEN 1 ELSE 0 END)) AS good_pct
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def coverage_pct(spark, sf):
    x = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    seen = F.count("quality")
    return x.groupBy("lang").agg(F.count("*").alias("n"), (100.0 * seen / F.greatest(F.lit(1), F.count("*"))).alias("labelled_pct"), (100.0 * F.count_if(F.col("quality") == 1) / F.greatest(F.lit(1), seen)).alias("good_pct"))


@register("SELECT user_id, event_type AS best, n FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1")
def best_speaker_per_cluster(spark, sf):
    x = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("f"))
    best = x.groupBy("user_id").agg(F.max(F.struct("n", (-F.col("f")).alias("neg"), "event_type")).alias("m"))
    return best.select("user_id", F.col("m.event_type").alias("best"), "m.n")


CAPS = [("click", 900), ("view", 450_000), ("error", 2_700), ("absent", 10)]


@register(f"""WITH p AS (SELECT event_type AS service, strftime(ts, '%Y-%m') AS period, event_id % 7 AS amount FROM events)
SELECT c.service, c.cap, coalesce(u, 0) AS used, greatest(0, c.cap - coalesce(u, 0)) AS "left", coalesce(u, 0) < c.cap AS open FROM (VALUES {', '.join(str(c) for c in CAPS)}) c(service, cap)
LEFT JOIN (SELECT service, sum(amount) AS u FROM p WHERE period = (SELECT max(period) FROM p) GROUP BY 1) q USING (service)""")
def quota_status(spark, sf):
    usage = table(spark, sf, "events").select(F.col("event_type").alias("service"), st.period_key(F.col("ts"), "monthly").alias("period"), (F.col("event_id") % 7).alias("amount"))
    period = usage.agg(F.max("period")).first()[0]
    return st.quota_status(usage, spark.createDataFrame(CAPS, "service string, cap int"), period)


ADMITTED_SQL = """WITH RECURSIVE r AS (SELECT user_id AS key, strftime(ts, '%Y-%m-%d') AS period, event_id AS seq, event_id % 7 + 1 AS amount FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY key, period ORDER BY seq) AS i FROM r),
f AS (SELECT key, period, seq, amount, i, amount <= 8 AS admitted, CASE WHEN amount <= 8 THEN amount ELSE 0 END AS used FROM o WHERE i = 1
  UNION ALL SELECT o.key, o.period, o.seq, o.amount, o.i, f.used + o.amount <= 8, f.used + CASE WHEN f.used + o.amount <= 8 THEN o.amount ELSE 0 END FROM f JOIN o ON o.key = f.key AND o.period = f.period AND o.i = f.i + 1)
SELECT key, period, seq, amount, admitted FROM f"""


@register(ADMITTED_SQL)
def quota_admission(spark, sf):
    r = table(spark, sf, "events").select(F.col("user_id").alias("key"), st.period_key(F.col("ts"), "daily").alias("period"), F.col("event_id").alias("seq"), (F.col("event_id") % 7 + 1).alias("amount"))
    return st.admit(r, 8)


@register("SELECT user_id, least(75, 65 + 2 * count(*) FILTER (WHERE event_type = 'error')) AS threshold FROM events GROUP BY 1")
def learned_thresholds(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(st.learned_ratio(F.count_if(F.col("event_type") == "error")).alias("threshold"))


@register("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, sum(CAST(value * 100 AS BIGINT)) AS total FROM events GROUP BY 1, 2")
def event_window_counts(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.col("ts").cast("timestamp"))
    x = e.groupBy(F.window("day", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"))
    return x.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


# ---- the rule engine over derived records ----


@register(f"SELECT page_id, bubble_id, 'translation_sentence_drop' AS pattern_name, 'translation_validation' AS stage, 'flag_for_review' AS severity, 'resolved' AS action_taken FROM turn_pairs_v WHERE {DROP}")
def gate_sentence_drops(spark, sf):
    x = view(spark, sf, "turn_pairs_v").withColumn("cross_check_mismatch", F.lit(False))
    return qa.event_log(qa.apply_stage(x, "translation_validation"), "page_id", "bubble_id")


@register()
def gate_translation_events(spark, sf):
    x = view(spark, sf, "turn_pairs_v").withColumn("cross_check_mismatch", similarity.cross_check_mismatch("source_text", "target_text"))
    return qa.event_log(qa.apply_stage(x, "translation_validation"), "page_id", "bubble_id")


@register("""WITH b AS (SELECT page_id, seq, seq % 3 AS z_order, CASE WHEN seq % 2 = 0 THEN 'rectangle' ELSE 'oval' END AS shape, conf_pct, x0 FROM lines_v)
SELECT page_id, seq, CASE WHEN z_order = 0 AND shape = 'rectangle' THEN CASE WHEN conf_pct < 94 AND x0 % 2 = 0 THEN 'shaped_caption' ELSE 'oval' END WHEN conf_pct < 94 AND (shape = 'rectangle' OR x0 % 2 = 0) THEN 'shaped_caption' ELSE shape END AS shape_type,
  CASE WHEN z_order = 0 AND shape = 'rectangle' THEN 1 ELSE 0 END + CASE WHEN conf_pct < 94 AND ((shape = 'rectangle' AND z_order <> 0) OR x0 % 2 = 0) THEN 1 ELSE 0 END + CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END AS n_events FROM b""")
def gate_inpainting_shapes(spark, sf):
    x = view(spark, sf, "lines_v").select("page_id", "seq", (F.col("seq") % 3).alias("z_order"), F.when(F.col("seq") % 2 == 0, "rectangle").otherwise("oval").alias("shape_type"), (F.col("conf_pct") / 100).alias("fill_ratio"), (F.col("x0") % 2 == 0).alias("is_rectangular_fill"))
    x = x.withColumns({"is_tinted": F.col("seq") % 5 == 0, "bg_is_tinted": F.lit(False), "text_is_spectral": F.lit(False), "tint": F.lit(None).cast("array<int>")})
    return qa.apply_stage(x, "bubble_inpainting").select("page_id", "seq", "shape_type", F.size("events").alias("n_events"))


@register("""SELECT page_id, count(*) AS n, count(*) FILTER (WHERE (seq % 6) * 20 < 40) AS n_clipped, count(*) FILTER (WHERE conf_pct <= 65 OR seq % 7 = 0) AS n_touching FROM
(SELECT page_id, seq, conf_pct FROM lines_v) GROUP BY page_id""")
def gate_review_edits(spark, sf):
    x = view(spark, sf, "lines_v").withColumns({"has_split_lines": F.lit(True), "constriction_ratio": F.col("conf_pct") / 100.0, "is_touching_merged": F.col("seq") % 7 == 0, "text_contour_margin": (F.col("seq") % 6) * 20.0, "is_clipped_edge": F.lit(False)})
    done = qa.apply_stage(x, "bubble_review_edit", qa.rules(constriction=0.65, margin=40.0))
    has = lambda name: F.exists("events", lambda e: e["pattern_name"] == name)
    return done.groupBy("page_id").agg(F.count("*").alias("n"), F.count_if(has("clipped_bubble_edge")).alias("n_clipped"), F.count_if(has("touching_bubbles_merged")).alias("n_touching"))


# ---- order-dependent or pattern-heavy operators without SQL ----


@register()
def seq_similarity(spark, sf):
    x = view(spark, sf, "turn_pairs_v")
    return x.select("page_id", "bubble_id", similarity.hybrid_similarity("source_text", "target_text").alias("similarity"), similarity.cross_check_mismatch("source_text", "target_text").alias("mismatch"), similarity.meaningful_edit("source_text", "target_text").alias("meaningful"))


@register()
def fuzzy_unique(spark, sf):
    return st.unique_facts(table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("seq"), "text"))


@register()
def edit_capture(spark, sf):
    x = view(spark, sf, "turn_pairs_v")
    return st.captured_edits(x.select(F.concat_ws("/", "page_id", "speaker").alias("key"), (F.col("page_id") * 100 + F.col("bubble_id")).alias("seq"), F.col("source_text").alias("source"), F.col("source_text").alias("before"), F.col("target_text").alias("after")))


@register()
def ema_signature(spark, sf):
    e = table(spark, sf, "embeddings")
    colour = lambda a: F.array(*[F.floor(F.abs(F.col("embedding")[a + i]) * 128).cast("int") for i in range(3)])
    return st.merged_signatures(e.select(F.col("label").cast("long").alias("key"), F.col("vec_id").alias("seq"), F.array(colour(0), colour(3)).alias("colours"), F.array(F.lit(0.6), F.lit(0.4)).alias("weights")))


TOKENS = "regexp_extract_all({}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_]+')"
_cased = lambda seen, w: f"CASE WHEN {seen} = upper({seen}) THEN '{w.upper()}' WHEN {seen} = lower({seen}) THEN '{w}' WHEN {seen}[1] = upper({seen}[1]) THEN '{w.capitalize()}' ELSE '{w}' END"


@register(f"""WITH t AS (SELECT doc_id, {TOKENS.format('text')} AS xs FROM documents), p AS (SELECT doc_id, xs, list_transform(xs, lambda x, i: lower(x) = 'of' AND xs[i + 1] = ' ' AND lower(xs[i + 2]) = 'the') AS hit FROM t)
SELECT doc_id, array_to_string(list_transform(xs, lambda x, i: CASE WHEN hit[i] THEN {_cased("(x || ' ' || xs[i + 2])", 'uning')} WHEN coalesce(hit[i - 1], FALSE) OR coalesce(hit[i - 2], FALSE) THEN ''
  WHEN lower(x) = 'thing' THEN {_cased('x', 'narsa')} WHEN lower(x) = 'the' THEN {_cased('x', 'ul')} ELSE x END), '') AS text FROM p""")
def glossary_case_enforce(spark, sf):
    return table(spark, sf, "documents").select("doc_id", lx.enforcement({"the": "ul", "thing": "narsa", "of the": "uning"})("text").alias("text"))


@register(f"""WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM benchmark), d AS (SELECT map(list(w), list(reverse(w))) AS m FROM w WHERE length(w) >= 3),
t AS (SELECT doc_id, list_transform({TOKENS.format('text')}, lambda x: CASE WHEN m[lower(x)] IS NULL THEN x WHEN x = upper(x) THEN upper(m[lower(x)]) WHEN x = lower(x) THEN m[lower(x)] ELSE upper(m[lower(x)][1]) || m[lower(x)][2:] END) AS xs FROM documents, d)
SELECT doc_id, array_to_string(xs, '') AS text FROM t""")
def glossary_large(spark, sf):
    """All words of the benchmark as a glossary, over all documents."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select(F.lower("w").alias("w")).distinct().where(F.length("w") >= 3)
    return table(spark, sf, "documents").select("doc_id", lx.enforcement({r.w: r.w[::-1] for r in words.collect()}, spark)("text").alias("text"))


FOLDS = [("the the ", "the "), ("[ \\t]{2,}", " "), ("(?i)of of ", "of ")]


def _folded_sql(flags: str) -> str:
    out = "text"
    for pattern, plain in FOLDS:
        out = f"regexp_replace({out}, '{pattern}', '{plain}', '{flags}')"
    return out


@register(f"SELECT doc_id, {_folded_sql('g')} AS native, {_folded_sql('gi')} AS compiled FROM documents")
def rule_fold(spark, sf):
    bounded(spark)
    return table(spark, sf, "documents").select("doc_id", lx.folded(F.col("text"), FOLDS).alias("native"), lx.rule_function(FOLDS)("text").alias("compiled"))


@register(f"""WITH m AS (SELECT conv_id, turn, array_to_string(list_transform({TOKENS.format('text')}, lambda x: CASE lower(x) WHEN 'the' THEN 'XNAME_THE_X' WHEN 'thing' THEN 'XNAME_THING_X' ELSE x END), '') AS masked FROM conversations)
SELECT conv_id, turn, masked, replace(replace(masked, 'XNAME_THE_X', 'the'), 'XNAME_THING_X', 'thing') AS unmasked FROM m""")
def mask_round_trip(spark, sf):
    mask, unmask = lx.masking([("the", "XNAME_THE_X"), ("thing", "XNAME_THING_X")])
    back = F.create_map(*[F.lit(v) for kv in (("XNAME_THE_X", "the"), ("XNAME_THING_X", "thing")) for v in kv])
    x = table(spark, sf, "conversations").select("conv_id", "turn", mask("text").alias("masked"))
    return x.select("conv_id", "turn", "masked", unmask("masked", back).alias("unmasked"))


EMPHASIS_SQL = f"""x AS (SELECT id, t0, t0[1:2] = '**' AND t0[-2:] = '**' AND NOT contains(regexp_replace(t0[3:length(t0) - 2], '^\\s+|\\s+$', '', 'g'), '**') AS around, regexp_split_to_array(t0, '\\s+') AS w0 FROM t),
y AS (SELECT id, CASE WHEN around OR (len(w0) > 1 AND 10 * len(list_filter(w0, lambda w: contains(w, '**'))) >= 8 * len(w0)) THEN regexp_replace(replace(t0, '**', ''), '^\\s+|\\s+$', '', 'g') ELSE t0 END AS t FROM x),
z AS (SELECT id, t, regexp_matches(t, '{em.BOLD}') AND list_sum(list_transform(regexp_extract_all(t, '{em.BOLD_INSIDE}', 1), lambda i: len(list_filter(regexp_split_to_array(i, '\\s+'), lambda w: w <> '')))) BETWEEN 1 AND least(3, 0.4 * len(regexp_split_to_array(t, '\\s+'))) AS stays FROM y),
l AS (SELECT id, t, ln, unnest(string_split(t, chr(10))[ln:ln]) AS line FROM (SELECT id, t, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS ln FROM z WHERE NOT coalesce(stays, FALSE) AND t <> '')),
s AS (SELECT id, ln, si, ss[si] AS sentence, ' ' || array_to_string(list_transform(regexp_split_to_array(ss[si], '\\s+'), lambda w: lower(regexp_replace(w, '[^{em.LETTER}''-]+', '', 'g'))), ' ') || ' ' AS joined,
  len(regexp_split_to_array(ss[si], '\\s+')) AS n FROM (SELECT id, ln, ss, unnest(range(1, len(ss) + 1)) AS si FROM
  (SELECT id, ln, list_filter(list_transform(string_split(regexp_replace(line, '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda q: regexp_replace(q, '^\\s+|\\s+$', '', 'g')), lambda q: q <> '') AS ss FROM l))),
p AS (SELECT *, CASE {' '.join(f"WHEN n > 2 AND contains(joined, ' {q.replace(chr(39), chr(39) * 2)} ') THEN length(joined[1:instr(joined, ' {q.replace(chr(39), chr(39) * 2)} ')]) - length(replace(joined[1:instr(joined, ' {q.replace(chr(39), chr(39) * 2)} ')], ' ', '')) - 1" for q in em.PHRASES)} ELSE -1 END AS phrase FROM s),
w AS (SELECT *, regexp_split_to_array(sentence, '\\s+')[i + 1] AS word, string_split(joined, ' ')[i + 2] AS bare FROM (SELECT *, unnest(range(0, n)) AS i FROM p)),
v AS (SELECT *, CASE WHEN bare = '' OR bare IN ({_list(w.replace("'", "''") for w in em.UNSTRESSED)}) THEN NULL
  {' '.join(f"WHEN bare IN ({_list(w.replace(chr(39), chr(39) * 2) for w in words)}) THEN {n}" for n, words in em.TIERS.items() if n >= 25)}
  WHEN regexp_matches(bare, '({'|'.join(em.STRESSED_ENDINGS)})$') THEN 25 WHEN bare IN ({_list(w.replace("'", "''") for w in em.TIERS[20])}) THEN 20 WHEN contains(word, '!') AND length(bare) >= 3 THEN 15 END AS score,
  CASE WHEN length(bare) >= 3 AND bare NOT IN ({_list(w.replace("'", "''") for w in em.UNSTRESSED)}) THEN i END AS weighty, CASE WHEN bare IN ({_list(w.replace("'", "''") for w in em.URGENT)}) AND contains(word, '!') THEN i END AS call FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY id, ln, si ORDER BY score DESC NULLS LAST, i) AS place, max(weighty) OVER (PARTITION BY id, ln, si) AS heavy, min(call) OVER (PARTITION BY id, ln, si) AS called FROM v),
g AS (SELECT id, ln, si, max(CASE WHEN place = 1 AND score IS NOT NULL THEN i END) AS best, max(CASE WHEN place = 2 AND score >= 25 THEN i END) AS next_one FROM r GROUP BY id, ln, si),
h AS (SELECT r.*, regexp_matches(sentence, '{em.BOLD}') AS marked, CASE WHEN n <= 2 THEN called WHEN phrase >= 0 THEN NULL ELSE coalesce(best, CASE WHEN contains(sentence, '!') THEN heavy END) END AS one,
  CASE WHEN n >= 8 AND phrase < 0 AND abs(next_one - best) >= 2 THEN next_one END AS two FROM r JOIN g USING (id, ln, si)),
o AS (SELECT id, ln, si, any_value(sentence) AS sentence, bool_or(marked) AS marked, any_value(n) AS n, any_value(called) AS called, string_agg(CASE
  WHEN i = one OR i = two THEN CASE WHEN word[1:2] = '**' AND word[-2:] = '**' THEN word WHEN regexp_matches(word, '{em.WORD.replace(chr(39), chr(39) * 2)}') THEN regexp_replace(word, '{em.WORD.replace(chr(39), chr(39) * 2)}', '\\1**\\2**\\3') ELSE '**' || word || '**' END
  WHEN phrase >= 0 AND i = phrase THEN regexp_replace(word, '{em.OPENERS.replace(chr(39), chr(39) * 2)}', '\\1**') WHEN phrase >= 0 AND i = phrase + 1 THEN regexp_replace(word, '{em.CLOSERS.replace(chr(39), chr(39) * 2)}', '**\\1') ELSE word END, ' ' ORDER BY i) AS told FROM h GROUP BY id, ln, si),
e AS (SELECT id, ln, string_agg(CASE WHEN marked OR (n <= 2 AND called IS NULL) THEN sentence ELSE told END, ' ' ORDER BY si) AS line FROM o GROUP BY id, ln),
u AS (SELECT l.id, string_agg(coalesce(e.line, ''), chr(10) ORDER BY l.ln) AS told FROM l LEFT JOIN e USING (id, ln) GROUP BY l.id)
SELECT z.id, CASE WHEN z.t = '' THEN '' WHEN coalesce(stays, FALSE) THEN z.t ELSE u.told END AS text FROM z LEFT JOIN u USING (id)"""


@register(f"WITH t AS (SELECT conv_id * 1000 + turn AS id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t0 FROM conversations), {EMPHASIS_SQL}")
def emphasis(spark, sf):
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), em.emphasis(F.col("text")).alias("text"))


STRESSED_SQL = f"""list_concat(list_filter(list_transform(regexp_extract_all(s, '{em.BOLD_INSIDE}', 1), lambda w: lower(regexp_replace(w, '[^{em.LETTER}''-]+', '', 'g'))), lambda w: w <> '' AND w NOT IN ({_list(w.replace("'", "''") for w in em.UNSTRESSED)})),
  CASE WHEN regexp_matches(s, '\\p{{Ll}}') THEN list_filter(list_transform(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: upper(replace(w, 'ß', 'SS')) = w AND lower(w) <> w), lambda w: lower(regexp_replace(w, '[^{em.LETTER}''-]+', '', 'g'))), lambda w: length(w) >= 2 AND w NOT IN ({_list(em.GLUE)})) ELSE [] END)"""


@register(f"SELECT page_id, bubble_id, {STRESSED_SQL} AS stressed FROM (SELECT page_id, bubble_id, coalesce(source_text, '') AS s FROM turn_pairs_v)")
def stressed_source_words(spark, sf):
    return view(spark, sf, "turn_pairs_v").select("page_id", "bubble_id", em.stressed_words(F.col("source_text")).alias("stressed"))


_BRIDGE = "MAP {" + ", ".join(f"'{w}': [{', '.join(repr(t) if chr(39) not in t else chr(39) + t.replace(chr(39), chr(39) * 2) + chr(39) for t in to)}]" for w, to in em.BRIDGES.items()) + "}"


@register(f"""WITH x AS (SELECT page_id, bubble_id, {STRESSED_SQL} AS stressed, list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '') AS ws FROM (SELECT page_id, bubble_id, coalesce(source_text, '') AS s, coalesce(target_text, '') AS t FROM turn_pairs_v)),
y AS (SELECT *, ' ' || array_to_string(list_transform(ws, lambda w: lower(regexp_replace(w, '[^{em.LETTER}''-]+', '', 'g'))), ' ') || ' ' AS joined, flatten(list_transform(stressed, lambda w: coalesce({_BRIDGE}[w], [w]))) AS wanted FROM x),
z AS (SELECT *, list_filter(list_transform(wanted, lambda c: {{'at': instr(joined, ' ' || c || ' '), 'n': len(string_split(c, ' '))}}), lambda p: p.at > 0)[1] AS hit FROM y),
h AS (SELECT *, length(joined[1:hit.at]) - length(replace(joined[1:hit.at], ' ', '')) AS place FROM z)
SELECT page_id, bubble_id, CASE WHEN hit IS NOT NULL THEN array_to_string(list_transform(ws, lambda w, i: CASE WHEN hit.n = 1 AND i = place THEN CASE WHEN w[1:2] = '**' AND w[-2:] = '**' THEN w
  WHEN regexp_matches(w, '{em.WORD.replace(chr(39), chr(39) * 2)}') THEN regexp_replace(w, '{em.WORD.replace(chr(39), chr(39) * 2)}', '\\1**\\2**\\3') ELSE '**' || w || '**' END
  WHEN hit.n > 1 AND i = place THEN regexp_replace(w, '{em.OPENERS.replace(chr(39), chr(39) * 2)}', '\\1**') WHEN hit.n > 1 AND i = place + hit.n - 1 THEN regexp_replace(w, '{em.CLOSERS.replace(chr(39), chr(39) * 2)}', '**\\1') ELSE w END), ' ') END AS projected FROM h""")
def emphasis_projection(spark, sf):
    x = view(spark, sf, "turn_pairs_v")
    return x.select("page_id", "bubble_id", em.projected(F.col("source_text"), F.col("target_text")).alias("projected"))


_APO = "''’ʻʼ`"
_HEAD = f"^([^{em.LETTER}]*)([{em.LETTER}{_APO}-]*[{em.LETTER}][{_APO}]?)([^{em.LETTER}]*)$"


@register(f"""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS word FROM documents), h AS (SELECT word, regexp_extract(word, '{_HEAD}', 1) AS lead, regexp_extract(word, '{_HEAD}', 2) AS body, regexp_extract(word, '{_HEAD}', 3) AS tail FROM w),
u AS (SELECT *, regexp_extract_all(body, '[oOgG][{_APO}]|[sScC][hH]|[nN][gG]|[{_APO}]|.') AS us FROM h),
v AS (SELECT *, list_filter(range(1, len(us) + 1), lambda i: regexp_matches(us[i], '^([aeiouAEIOU]|[oO][{_APO}])$')) AS vs FROM u),
c AS (SELECT *, list_transform(range(1, len(vs)), lambda k: vs[k] + CASE WHEN vs[k + 1] - vs[k] = 1 THEN 0 WHEN regexp_matches(us[vs[k] + 1], '^[{_APO}]$') THEN 1 ELSE least(vs[k + 1] - vs[k] - 2, 2) END) AS cuts FROM v),
e AS (SELECT *, list_concat([0], cuts) AS starts, list_concat(cuts, [len(us)]) AS ends FROM c)
SELECT word, CASE WHEN length(body) < 3 THEN [word] ELSE list_transform(starts, lambda a, i: CASE WHEN i = 1 THEN lead ELSE '' END || array_to_string(us[a + 1:ends[i]], '') || CASE WHEN i = len(starts) THEN tail ELSE '' END) END AS syllables FROM e""")
def syllables(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.split("text", "\\s+")).alias("word")).distinct()
    return words.select("word", lettering.syllables_of("word").alias("syllables"))


PARTED_SQL = f"array_to_string(list_transform(string_split(core, '-'), lambda x: coalesce({sd.sql_known(sd.sql_core('x'), 'm')}, {sd.sql_by_letters(sd.sql_core('x'))}) || regexp_extract(x, '({sd.TAIL})', 1)), '-')"


@register(f"""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS word FROM documents), d AS (SELECT {sd.sql_map()} AS m),
c AS (SELECT word, m, regexp_extract(word, '({sd.TAIL})', 1) AS tail, {sd.sql_core('word')} AS core FROM w, d)
SELECT word, coalesce({sd.sql_known('core', 'm')}, CASE WHEN contains(core, '-') THEN {PARTED_SQL} END, {sd.sql_by_letters('core')}) || tail AS written FROM c""")
def transliterate(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.split("text", "\\s+")).alias("word")).distinct()
    return words.select("word", sd.spelling(F.col("word")).alias("written"))
