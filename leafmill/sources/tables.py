"""Readers of the base tables and the derived page views that stand for scanned pages.

The view texts are portable SQL; ``{name}`` is a base table, so that the same text can be run
over DataFrames here and over tables elsewhere.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "lines_v": """SELECT l_orderkey AS page_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
       l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS INT) AS seq,
  CAST((l_partkey * 37) % 600 AS INT) AS x0, CAST((l_suppkey * 53) % 400 AS INT) AS y0,
  CAST((l_partkey * 37) % 600 AS INT) + 40 + 4 * CAST(l_quantity AS INT) AS x1,
  CAST((l_suppkey * 53) % 400 AS INT) + 16 + 2 * l_linenumber AS y1,
  CAST(100 - 500 * l_discount AS INT) AS conf_pct FROM {lineitem}""",
    "rects_v": """SELECT o_orderkey AS page_id, 1 AS rect_idx,
  CAST((o_custkey * 29) % 500 AS INT) AS x0, CAST((o_orderkey * 31) % 300 AS INT) AS y0,
  CAST((o_custkey * 29) % 500 AS INT) + 120 + CAST(o_custkey % 80 AS INT) AS x1,
  CAST((o_orderkey * 31) % 300 AS INT) + 60 + CAST(o_custkey % 40 AS INT) AS y1 FROM {orders}""",
    # outlines of one to three lobes, one above (or, across, beside) the other: half widths a, necks n1 and n2
    "outlines_v": """SELECT page_id, across, m, a, CASE WHEN page_id % 3 = 0 THEN a ELSE 15 + k % 50 END AS n1, CASE WHEN page_id % 4 < 2 THEN a - 15 ELSE 20 + k % 40 END AS n2
  FROM (SELECT o_orderkey AS page_id, o_orderkey % 2 = 1 AS across, CAST(o_custkey AS INT) AS k, CAST(100 + (o_custkey * 29) % 80 AS INT) AS a,
    CAST(CASE WHEN o_orderkey % 2 = 1 THEN 180 + o_custkey % 60 ELSE 250 + o_custkey % 300 END AS INT) AS m FROM {orders})""",
    "panels_v": """SELECT * FROM (VALUES (1,0,0,390,190),(2,410,0,850,190),(3,0,210,390,450),(4,410,210,850,450))
  AS t(panel_idx, px0, py0, px1, py1)""",
    "terms_v": """SELECT p_partkey AS seq, lower(trim(p_name)) AS source_term, p_type AS canonical,
  CASE p_size % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'character_name' WHEN 2 THEN 'real_person' ELSE 'term' END AS entry_type,
  CASE p_partkey % 4 WHEN 0 THEN 'meaning' WHEN 1 THEN 'transliteration' WHEN 2 THEN 'transliteration_override' ELSE 'fixed' END AS method,
  (p_size % 2 = 0) AS locked, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS reason FROM {part}""",
    "turn_pairs_v": """SELECT a.conv_id AS page_id, a.turn AS bubble_id, a.role AS speaker, a.text AS source_text, b.text AS target_text
  FROM {conversations} a JOIN {conversations} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    "gate_events_v": """SELECT event_id AS seq, user_id AS page_id, event_type AS pattern_name,
  CASE WHEN event_type = 'error' THEN 'flag_for_review' ELSE 'auto_fix' END AS severity, value, ts, props FROM {events}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", sql))}
    if name == "lines_v":
        # named below its window, a page's lines are known to lie together, and are not sent again by page
        used["lineitem"] = used["lineitem"].withColumnRenamed("l_orderkey", "page_id")
        sql = sql.replace("l_orderkey AS page_id", "page_id").replace("l_orderkey", "page_id")
    return spark.sql(sql, **used) if used else spark.sql(sql)


def with_views(sql: str) -> str:
    """``sql`` with the views it names put in front, for an engine that has the base tables."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    heads = ", ".join(f"{v} AS ({re.sub(r'[{}]', '', VIEWS[v])})" for v in used)
    if not used:
        return sql
    body = sql.strip()
    recursive = re.match(r"WITH\s+RECURSIVE\b", body, re.I)
    body = re.sub(r"^WITH(\s+RECURSIVE)?\b", ", ", body, flags=re.I) if re.match(r"WITH\b", body, re.I) else " " + body
    return f"WITH {'RECURSIVE ' if recursive else ''}{heads}{body}"
