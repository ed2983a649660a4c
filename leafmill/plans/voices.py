"""Queries over voices, facts, prompts and profiles of width."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.operators import records as rc
from leafmill.plans.registry import register
from leafmill.sources.tables import table, view

FACTS = [("(^| )the ", "speaks of the"), ("tion( |[.,])", "likes long words"), ("ing[ .,]", "acts"), ("[?]", "asks")]


@register("SELECT conv_id, turn, unnest(fs) AS fact FROM (SELECT conv_id, turn, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{f}' END" for p, f in FACTS) + "], lambda x: x IS NOT NULL) AS fs FROM conversations)")
def fact_rules(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.explode(tx.facts(F.col("text"), FACTS)).alias("fact"))


@register("SELECT conv_id, turn, regexp_replace(regexp_replace(replace(text, 'the ', 'ze '), ' of ', ' ov ', 'g'), '\\.\\s*$', '!') AS line FROM conversations")
def persona_rewrite(spark, sf):
    nothing = F.create_map().cast("map<string,string>")
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.persona_line(F.col("text"), nothing, [("the ", "ze "), (" of ", " ov ")], loud=True).alias("line"))


@register("SELECT entry_type, string_agg(CAST(r AS VARCHAR) || '. ' || source_term, chr(10) ORDER BY r) AS prompt FROM (SELECT entry_type, source_term, row_number() OVER (PARTITION BY entry_type ORDER BY length(source_term) DESC, source_term) AS r FROM (SELECT DISTINCT entry_type, source_term FROM terms_v)) GROUP BY 1")
def numbered_prompts(spark, sf):
    names = F.array_sort(F.collect_set(F.struct((-F.length("source_term")).alias("n"), "source_term")))
    return view(spark, sf, "terms_v").groupBy("entry_type").agg(tx.numbered(F.transform(names, lambda s: s["source_term"])).alias("prompt"))


NOT_A, NOT_B = "(^| )(not|no|the|nicht)( |$)", "(^| )(of|and|und)( |$)"


@register(f"""WITH t AS (SELECT page_id, bubble_id, source_text AS s, target_text AS b, list_distinct(regexp_extract_all(lower(source_text), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS ta, list_distinct(regexp_extract_all(lower(target_text), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS tb FROM turn_pairs_v)
SELECT page_id, bubble_id, len(ta) > 0 AND len(tb) > 0 AND NOT (regexp_matches(s, '{NOT_B}') <> regexp_matches(b, '{NOT_B}') AND regexp_matches(b, '{NOT_B}') <> regexp_matches(s, '{NOT_A}'))
  AND 100 * len(list_intersect(ta, tb)) >= 15 * greatest(1, least(len(ta), len(tb))) AS agree FROM t""")
def translation_agreement(spark, sf):
    x = view(spark, sf, "turn_pairs_v")
    return x.select("page_id", "bubble_id", tx.agreement(F.col("source_text"), F.col("target_text"), F.col("source_text"), NOT_A, NOT_B).alias("agree"))


@register("SELECT page_id, replace(replace(replace(url, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS url, len(regexp_extract_all(html, '&(amp|quot|lt|gt|nbsp);')) AS n_references FROM pages")
def plain_references(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.plain_entities(F.col("url")).alias("url"), F.regexp_count("html", F.lit("&(amp|quot|lt|gt|nbsp);")).cast("long").alias("n_references"))


@register("""WITH p AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: CAST(floor(abs(x) * 100) AS INT)) AS w FROM embeddings),
m AS (SELECT vec_id, w, least(list_max(w[1:4]), list_max(w[13:16])) AS peak, list_min(w[5:12]) AS low FROM p)
SELECT vec_id, 4 + list_position(w[5:12], low) AS "at", CAST(1000 * low // greatest(1, peak) AS BIGINT) AS ratio FROM m WHERE 1000 * low // greatest(1, peak) <= 50""")
def neck_search(spark, sf):
    w = F.transform(F.slice("embedding", 1, 16), lambda x: F.floor(F.abs(x) * 100).cast("int"))
    x = table(spark, sf, "embeddings").select("vec_id", rc.neck(w, 0.05).alias("n"))
    return x.where("n is not null").select("vec_id", "n.at", "n.ratio")


@register("""SELECT conv_id, turn, regexp_extract_all('[{"id": 1, "text": "' || regexp_replace(text, '["\\\\\n]', ' ', 'g') || '"}, {"text": "cut', '"text"\\s*:\\s*"((?:[^"\\\\]|\\\\.)*)"', 1) AS found FROM conversations""")
def broken_json_strings(spark, sf):
    x = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit('[{"id": 1, "text": "'), F.regexp_replace("text", '["\\\\\\\\\n]', " "), F.lit('"}, {"text": "cut')).alias("j"))
    return x.select("conv_id", "turn", tx.json_strings(F.col("j"), "text").alias("found"))
