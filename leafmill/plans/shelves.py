"""Queries over stores, caches, defaults, normal forms and rewrite cascades."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import emphasis as em
from leafmill.functions import sounds as sd
from leafmill.functions import text as tx
from leafmill.functions.tables import register_tables
from leafmill.operators import cascades as cc
from leafmill.operators import records as rc
from leafmill.operators import state as st
from leafmill.plans.registry import register
from leafmill.session import shared_folder
from leafmill.sources import stores as ss
from leafmill.sources.tables import table, view
from leafmill.sources.versions import VersionedStore

# ---- stores: written to the shared folder as the store keeps them, then read back ----


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/leafmill-store-{name}-{uuid.uuid4().hex}"


def _as_file(records: DataFrame, holder: str, path: str) -> None:
    """All records of a store of fixed size as one JSON object."""
    records.agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(*records.columns))).alias(holder))).alias("value")).write.text(path)


@register("SELECT n_name AS source_term, 'R' || n_regionkey AS canonical_uzbek, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN 'p' || n_nationkey END, 'auto') AS first_seen_page, n_nationkey % 2 = 0 OR n_nationkey % 5 <> 0 AS locked, 'term' AS entry_type, 'fixed' AS method FROM nation")
def store_terms(spark, sf):
    n = table(spark, sf, "nation")
    terms = n.select(F.col("n_name").alias("source_term"), F.concat(F.lit("R"), "n_regionkey").alias("canonical_uzbek"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("p"), "n_nationkey")).alias("first_seen_page"), F.when((F.col("n_nationkey") % 2 != 0) & (F.col("n_nationkey") % 5 == 0), False).alias("locked"))
    _as_file(terms, "terms", path := _place(spark, "terms"))
    read = ss.with_defaults(ss.read_json(spark, path, ss.TERM, "terms"), ss.DEFAULTS["terms"])
    return read.select("source_term", "canonical_uzbek", "first_seen_page", "locked", "entry_type", "method")


@register("SELECT trim(r_name) AS k, 'v' || r_regionkey AS v FROM region WHERE r_name <> 'ASIA'")
def store_glossary(spark, sf):
    pairs = table(spark, sf, "region").select(F.concat(F.lit("  "), "r_name").alias("k"), F.concat(F.lit("v"), "r_regionkey", F.lit(" ")).alias("v")).unionByName(spark.createDataFrame([("  ", "x")], "k string, v string"))
    x = pairs.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("terms"))
    x.select(F.to_json(F.struct("terms")).alias("value")).write.text(path := _place(spark, "glossary"))
    return ss.removed(ss.read_map(spark, path), "asia")


@register("SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 OR n_nationkey % 4 = 0 THEN 'seed' ELSE 'own' END AS tone FROM nation WHERE n_nationkey % 4 <> 0 OR n_nationkey < 100")
def store_seeds(spark, sf):
    n = table(spark, sf, "nation")
    own = n.where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, " ").otherwise("own").alias("tone"))
    seeds = n.select(F.lower("n_name").alias("name"), F.lit("seed").alias("tone"))

    def unavailable():
        raise OSError("no connection")

    profiles = ss.first_available(unavailable, lambda: own.limit(0), lambda: own, empty_is_missing=True)
    return ss.seeded(profiles, seeds).select(F.upper("name").alias("name"), "tone")


@register("SELECT DISTINCT word, length(word) >= 3 AS protected FROM (SELECT unnest(regexp_extract_all(upper(p_name || ' ' || p_type), '[A-Z]{2,}')) AS word FROM part)")
def vocabulary_harvest(spark, sf):
    words = ss.vocabulary(table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("t")), "t")
    return words.select("word", (F.length("word") >= 3).alias("protected"))


@register("SELECT 'p' || user_id AS page, CAST(event_id AS INT) AS bubble_id, event_type AS pattern_name, CASE WHEN event_type = 'error' THEN 'flag_for_review' ELSE 'auto_fix' END AS severity, count(*) AS n FROM (SELECT * FROM events UNION ALL SELECT * FROM events) GROUP BY ALL")
def store_appended(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("p"), "user_id").alias("page"), F.col("event_id").cast("string").alias("bubble_id"), F.col("event_type").alias("pattern_name"), F.when(F.col("event_type") == "error", "flag_for_review").alias("severity"), F.lit("x").alias("column_that_the_store_lacks"))
    path = _place(spark, "events")
    for _ in range(2):
        ss.append(e, path, ss.EVENT, ss.DEFAULTS["events"])
    return spark.read.parquet(path).groupBy("page", "bubble_id", "pattern_name", "severity").agg(F.count("*").alias("n"))


@register("SELECT CAST(user_id AS VARCHAR) AS page, CAST(event_id AS INT) AS bubble_id FROM events WHERE event_type <> 'error'")
def store_migrated(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("page"), F.when(F.col("event_type") == "error", "none").otherwise(F.col("event_id").cast("string")).alias("bubble_id"))
    ss.migrated(e, path := _place(spark, "migrated"), ss.EVENT, ss.DEFAULTS["events"])
    return spark.read.parquet(path).select("page", "bubble_id")


# a store of 16 buckets, by the hash of the key: all parts by name, then a second version with a few of them
_BUCKET = "CAST('0x' || substr(md5({}), 1, 6) AS BIGINT) % 16"


@register(f"""WITH a AS (SELECT lower(trim(p_name)) || ' ' || p_size AS term, p_brand AS canonical, p_partkey AS seq FROM part),
v1 AS (SELECT term, arg_max(canonical, seq) AS canonical FROM a GROUP BY term), v2 AS (SELECT term, 'new ' || arg_max(canonical, seq) AS canonical FROM a WHERE seq % 150 = 7 GROUP BY term),
t AS (SELECT DISTINCT {_BUCKET.format('term')} AS b FROM v2)
SELECT v1.term, coalesce(v2.canonical, v1.canonical) AS canonical, v1.canonical AS canonical_before, {_BUCKET.format('v1.term')} IN (SELECT b FROM t) AS read_again FROM v1 LEFT JOIN v2 USING (term)""")
def store_versions(spark, sf):
    """Both versions of a store, and what a holder of the first one has to read again."""
    p = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_size").alias("term"), F.col("p_brand").alias("canonical"), F.col("p_partkey").alias("seq"))
    store = VersionedStore(spark, _place(spark, "versions"), "term string, canonical string", "term", buckets=16)
    first = store.upsert(p, "seq")
    store.upsert(p.where("seq % 150 = 7").withColumn("canonical", F.concat(F.lit("new "), "canonical")), "seq")
    again = store.changed(first).select("term", F.lit(True).alias("read_again"))
    before = store.read(first).withColumnRenamed("canonical", "canonical_before")
    return store.read().join(before, "term").join(again, "term", "left").select("term", "canonical", "canonical_before", F.coalesce("read_again", F.lit(False)).alias("read_again"))


@register("""WITH a AS (SELECT DISTINCT lower(substr(c_mktsegment, 1, 1 + c_custkey % 4)) AS asked FROM customer), p AS (SELECT DISTINCT c_mktsegment AS name FROM customer),
s AS (SELECT name, row_number() OVER (ORDER BY name) AS seq FROM p), m AS (SELECT asked, name, row_number() OVER (PARTITION BY asked ORDER BY CASE WHEN lower(name) = asked THEN 0 ELSE 1 END, seq) AS r FROM a JOIN s ON contains(lower(name), asked) OR contains(asked, lower(name)))
SELECT asked, name AS profile FROM a LEFT JOIN (SELECT * FROM m WHERE r = 1) USING (asked)""")
def profile_lookup(spark, sf):
    from pyspark.sql import Window

    c = table(spark, sf, "customer")
    asked = c.select(F.lower(F.expr("substr(c_mktsegment, 1, cast(1 + c_custkey % 4 as int))")).alias("asked")).distinct()
    names = c.select(F.col("c_mktsegment").alias("name")).distinct()  # a handful of segments
    profiles = names.select("name", F.row_number().over(Window.orderBy("name")).alias("seq"), F.lit(None).cast("array<string>").alias("aliases"))
    return ss.alias_lookup(asked, profiles)


@register("SELECT count(*) FILTER (WHERE event_id % 3 = 0 OR k IN (SELECT props FROM events WHERE event_id % 3 = 0)) AS hits, count(DISTINCT CASE WHEN k NOT IN (SELECT props FROM events WHERE event_id % 3 = 0) THEN k END) AS misses FROM (SELECT event_id, props AS k FROM events)")
def cache_hits(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("props").alias("cache_key"))
    known = e.where("event_id % 3 = 0").select("cache_key").distinct().withColumn("result", F.upper("cache_key"))
    hits, misses = st.cached(e, known)
    return hits.agg(F.count("*").alias("hits")).join(misses.agg(F.count("*").alias("misses")))  # one row each


DICTIONARY_SQL = ", ".join(f"('{n.replace(chr(39), chr(39) * 2)}', '{k}', {r})" for n, k, r, _ in sd.dictionary())


@register(f"""WITH s(name, kind, rank) AS (VALUES {DICTIONARY_SQL}), b AS (SELECT name, kind FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY rank) = 1),
i AS (SELECT page_id, seq, CASE seq % 4 WHEN 0 THEN 'BOOM' WHEN 1 THEN ' ' WHEN 2 THEN 'crash' ELSE 'hello there' END AS original, CASE WHEN seq % 3 = 0 THEN 'POW' END AS clean, x0, y0, CASE WHEN seq % 2 = 0 THEN x1 END AS x1, CASE WHEN seq % 2 = 0 THEN y1 END AS y1 FROM lines_v),
t AS (SELECT *, coalesce(CASE WHEN trim(clean) <> '' THEN clean END, CASE WHEN trim(original) <> '' THEN original END, '') AS text FROM i)
SELECT page_id, seq, text, coalesce(x1, x0 + 100) AS x1, coalesce(y1, y0 + 30) AS y1, b.kind AS sfx_category, b.kind IS NOT NULL AS is_sfx FROM t LEFT JOIN b ON name = regexp_replace(upper(text), '[^A-Z]+', '', 'g')""")
def record_defaults(spark, sf):
    pick = F.col("seq") % 4
    x = view(spark, sf, "lines_v").select("page_id", "seq", "x0", "y0", F.when(F.col("seq") % 2 == 0, F.col("x1")).alias("x1"), F.when(F.col("seq") % 2 == 0, F.col("y1")).alias("y1"), F.when(pick == 0, "BOOM").when(pick == 1, " ").when(pick == 2, "crash").otherwise("hello there").alias("original_text"), F.when(F.col("seq") % 3 == 0, "POW").alias("clean_text"))
    return rc.completed(x).select("page_id", "seq", F.col("clean_text").alias("text"), "x1", "y1", "sfx_category", "is_sfx")


# ---- normal forms of text ----

APOSTROPHES = f"translate({{}}, '{tx.APOSTROPHES}', '{chr(39) * 2 * len(tx.APOSTROPHES)}')"
PLAIN = APOSTROPHES.format("t")
_letter = lambda x: f"regexp_matches(coalesce({x}, ''), '^[A-Za-z]$')"


@register(f"""WITH c AS (SELECT conv_id, turn, text AS t, string_split(regexp_replace(text, '["“”„«»]', '', 'g'), '') AS cs FROM conversations)
SELECT conv_id, turn, {PLAIN} AS plain,
  upper(replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({PLAIN}, '\\*+', '', 'g'), '!{{2,}}', '!', 'g'), '[ \\t]+', ' ', 'g'), '([.!?…])\\s+', '\\1' || chr(10), 'g')), 'ß', 'SS')) AS comic,
  regexp_replace(array_to_string(list_transform(cs, lambda x, i: CASE WHEN x IN ('''', '‘', '’') AND NOT ({_letter('cs[i - 1]')} AND {_letter('cs[i + 1]')}) THEN '' ELSE x END), ''), '[ \\t]{{2,}}', ' ', 'g') AS unquoted FROM c""")
def text_forms(spark, sf):
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.plain_apostrophes(t).alias("plain"), tx.comic_case(t).alias("comic"), tx.unquoted(t).alias("unquoted"))


KEY_STEPS = [("n't\\b", " not"), ("'re\\b", " are"), ("'m\\b", " am"), ("'ll\\b", " will"), ("'ve\\b", " have"), ("[^a-z0-9 ]+", " "), (" +", " ")]


@register(f"SELECT conv_id, turn, trim({cc.sql_fold(APOSTROPHES.format('text').join(['lower(', ')']), KEY_STEPS)}) AS line_key FROM conversations")
def line_keys(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.line_key(F.col("text")).alias("line_key"))


@register("""WITH x AS (SELECT page_id, bubble_id, source_text AS s, target_text AS t, regexp_extract(source_text, '^\\s*(\\.{2,}|…|-+)', 1) AS lead, regexp_extract(trim(source_text), '([.!?…]+)$', 1) AS mark FROM turn_pairs_v),
y AS (SELECT *, CASE WHEN lead <> '' AND NOT starts_with(t, lead) THEN lead || t ELSE t END AS u FROM x) SELECT page_id, bubble_id, CASE WHEN mark <> '' AND NOT regexp_matches(trim(u), '[.!?…]$') THEN rtrim(u) || mark ELSE u END AS ended FROM y""")
def restored_ends(spark, sf):
    return view(spark, sf, "turn_pairs_v").select("page_id", "bubble_id", tx.restored_end(F.col("source_text"), F.col("target_text")).alias("ended"))


@register("""SELECT conv_id, turn, len(regexp_split_to_array(text, '[.!?…]+')) AS n_end, len(regexp_split_to_array(text, '[.!?…:]+')) AS n_end_colon, len(string_split(regexp_replace(text, '([.!?…;])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS n_after_clause,
  len(string_split(regexp_replace(text, '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS n_after_end, len(regexp_split_to_array(text, '[.!?…—/–]+')) AS n_dash FROM conversations""")
def sentence_splits(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", *[F.size(F.split("text", p)).cast("long").alias(f"n_{name}") for name, p in tx.SPLITS.items()])


@register("""WITH p AS (SELECT conv_id, turn, string_split(regexp_replace(text, '([.!?…])([ \t]+)', '\\1' || chr(1) || '\\2' || chr(2), 'g'), chr(1)) AS ps FROM conversations)
SELECT conv_id, turn, array_to_string(list_transform(ps, lambda x, i: CASE WHEN i = 1 THEN x ELSE CASE WHEN regexp_matches(ps[i - 1], '([A-Z]|(^|[^\\p{L}\\p{N}_])(Dr|Mr|Ms|vs|Mrs|Prof))\\.$') THEN string_split(x, chr(2))[1] ELSE chr(10) END || string_split(x, chr(2))[2] END), '') AS lines FROM p""")
def sentence_lines(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.sentence_lines(F.col("text")).alias("lines"))


@register("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def repaired_json(spark, sf):
    reply = F.concat(F.lit("Here it is:\n```json\n"), F.regexp_replace("props", "\\}$", ",}"), F.lit("\n``` so far"))
    return table(spark, sf, "events").select("event_id", F.from_json(tx.clean_json(reply), "k int")["k"].alias("k"))


LEAKS, PERMITTED, ENDINGS = ["THE", "THAT", "ON", "IN", "AND", "DER", "ONTI"], ["IN"], ["ON", "EN", "ER", "TI"]
_in = lambda words: ", ".join(f"'{w}'" for w in words)


@register(f"""WITH w AS (SELECT conv_id, turn, text, list_transform(regexp_extract_all(text, '[A-Za-z''-]+'), lambda x: upper(trim(x))) AS ws FROM conversations),
h AS (SELECT conv_id, turn, list_concat(regexp_extract_all(text, 'XNAME_[A-Za-z0-9_]+_X'), list_filter(ws, lambda x: length(x) >= 2 AND x NOT IN ({_in(PERMITTED)}) AND (x IN ({_in(LEAKS)})
  {' '.join(f"OR (ends_with(x, '{e}') AND length(x) > {len(e) + 2} AND x[1:length(x) - {len(e)}] IN ({_in(LEAKS)}))" for e in ENDINGS)}))) AS xs FROM w)
SELECT conv_id, turn, array_to_string(list_filter(xs, lambda x, i: list_position(xs, x) = i), ',') AS residue FROM h""")
def residue(spark, sf):
    found = tx.residue_tokens(F.col("text"), LEAKS, PERMITTED, ENDINGS)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(found, ",").alias("residue"))


# ---- cascades ----

MASKED_NAMES = [("\\bthe thing\\b", "XNAME_THE_THING_X")]
LEADING = "regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')"


@register(f"SELECT conv_id, turn, trim({cc.sql_fold(APOSTROPHES.format(LEADING), cc.source_steps(MASKED_NAMES))}) AS ready FROM conversations")
def source_ready(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", cc.source_ready(F.col("text"), MASKED_NAMES).alias("ready"))


CALQUES = [("\\bthe of\\b", "of the"), ("\\bthat in\\s+", "in that "), ("\\bon(on)+\\b", "on")]
IDIOMS = [("(THE|OF)\\b", "ARTIKL"), ("[A-Z]{2,9}[!.]*$", "BIR SO'Z.")]


def _idiom_sql(line: str) -> str:
    whole = f"upper(replace(trim(coalesce({line}, '')), 'ß', 'SS'))"
    bare = cc.sql_fold(whole, [("^[.\\-_\\s]+", ""), ("[.\\-_\\s!?:,]+$", "")])
    tries = " ".join(f"WHEN {whole} <> '' AND (regexp_matches({whole}, '(?i)^(?:{p})') OR ({bare} <> '' AND regexp_matches({bare}, '(?i)^(?:{p})'))) THEN '{said.replace(chr(39), chr(39) * 2)}'" for p, said in IDIOMS)
    return f"CASE {tries} END"


_lettered = lambda x: f"upper(replace({APOSTROPHES.format(f'trim({x})')}, 'ß', 'SS'))"
_LOOSE = cc.LOOSE_GENITIVE.replace("'", "''")


@register(f"""WITH a AS (SELECT page_id, bubble_id, source_text AS s, target_text AS t, {cc.sql_fold("trim(coalesce(target_text, ''))", cc.target_steps(CALQUES))} AS x FROM turn_pairs_v),
b AS (SELECT *, regexp_extract(x, '{_LOOSE}', 1) AS lead, regexp_extract(x, '{_LOOSE}', 2) AS stem, regexp_extract(x, '{_LOOSE}', 3) AS trail FROM a),
c AS (SELECT *, CASE WHEN regexp_matches(x, '{_LOOSE}') THEN CASE WHEN lead = '' THEN '...' ELSE lead END || CASE WHEN lower(stem) IN ({_in(cc.BEASTS)}) THEN 'maxluq tabiati' ELSE stem END || ' haqida' || CASE WHEN trail = '' THEN '.' ELSE trail END ELSE x END AS y FROM b),
d AS (SELECT *, CASE WHEN regexp_matches(coalesce(s, ''), '{cc.DEED}') THEN {cc.sql_fold('y', cc.OWN_DEED)} ELSE y END AS z FROM c),
e AS (SELECT *, {cc.sql_fold(cc.sql_fold('z', cc.interjection_steps()), cc.DOUBLED)} AS w FROM d)
SELECT page_id, bubble_id, CASE WHEN trim(coalesce(t, '')) = '' AND trim(coalesce(s, '')) = '' THEN '' ELSE coalesce({_lettered(_idiom_sql('s'))}, {_lettered(_idiom_sql('t'))}, {_lettered(cc.sql_fold('w', cc.any_case(cc.NAMES)))}) END AS text FROM e""")
def naturalised(spark, sf):
    x = view(spark, sf, "turn_pairs_v")
    return x.select("page_id", "bubble_id", cc.naturalised(F.col("target_text"), F.col("source_text"), IDIOMS, CALQUES).alias("text"))


TYPING = [("\\bthh", "th"), ("\\banan\\b", "ana"), ("\\beder\\b", "er")]


@register()
def typing_mended(spark, sf):
    rules = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(TYPING)], "seq int, pattern string, replacement string")
    return table(spark, sf, "documents").select("doc_id", cc.typing_mended(F.col("text"), cc.rule_table(rules)).alias("text"))


@register(f"""WITH x AS (SELECT page_id, bubble_id, coalesce(source_text, '') AS s, coalesce(target_text, '') AS t FROM turn_pairs_v)
SELECT page_id, bubble_id, len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: upper(replace(w, 'ß', 'SS')) = w AND lower(w) <> w)) AS n_capitals, regexp_matches(t, '{em.BOLD}') AS has_bold FROM x""")
def stress_marks(spark, sf):
    x = view(spark, sf, "turn_pairs_v")
    capital = F.filter(F.split(F.coalesce("source_text", F.lit("")), "\\s+", -1), lambda w: (F.upper(w) == w) & (F.lower(w) != w))
    return x.select("page_id", "bubble_id", F.size(capital).cast("long").alias("n_capitals"), F.coalesce("target_text", F.lit("")).rlike(em.BOLD).alias("has_bold"))


_SAID = "SELECT conv_id, turn, role, i, trim(part, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS sentence FROM (SELECT conv_id, turn, role, unnest(ps) AS part, unnest(range(len(ps))) AS i FROM (SELECT conv_id, turn, role, regexp_split_to_array(text, '[.!?…]+') AS ps FROM conversations))"


@register(f"WITH s AS ({_SAID}) SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS INT) AS n, sentence FROM s WHERE sentence <> ''")
def sentence_table(spark, sf):
    """Each conversation's sentences, numbered through, by the table function over a partitioned table."""
    register_tables(spark)
    return spark.sql("SELECT * FROM split_sentences(TABLE(SELECT * FROM {said}) PARTITION BY (conv_id) ORDER BY (turn), 'text')", said=table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"))


@register(f"WITH s AS ({_SAID}) SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS INT) AS n, length(sentence) AS letters FROM s WHERE sentence <> ''")
def sentence_lengths(spark, sf):
    """The same by a lateral join with the function of one text."""
    register_tables(spark)
    return spark.sql("SELECT conv_id, turn, n, CAST(length(sentence) AS BIGINT) AS letters FROM {said}, LATERAL sentences_of(text)", said=table(spark, sf, "conversations"))
