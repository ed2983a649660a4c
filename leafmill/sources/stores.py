"""Stores: JSON files of several shapes, defaults, seeds, fallbacks, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = "page string, bubble_id int, stage string, pattern_name string, severity string, action_taken string, timestamp double, details map<string,string>"
TERM = "source_term string, canonical_uzbek string, first_seen_page string, locked boolean, aliases array<string>, entry_type string, method string, reason string"
PROFILE = "name string, aliases array<string>, voice_traits array<string>, established_facts array<string>, sample_lines array<struct<en:string,literal_mt:string,voice_uz:string>>, phrase_replacements array<array<string>>, exact_lines map<string,string>, forbidden_tones array<string>"
CORRECTION = "page string, timestamp double, tool_used string, bubble_id int, original_contour array<array<int>>, corrected_contours array<array<array<int>>>, metadata map<string,string>"
#: Values for missing fields, by store.
DEFAULTS = {
    "terms": {"first_seen_page": "auto", "locked": True, "entry_type": "term", "method": "fixed"},
    "events": {"severity": "auto_fix", "action_taken": "", "stage": ""},
    "corrections": {"tool_used": "", "page": ""},
}


def read_json(spark: SparkSession, path: str, schema: str, holder: str | None = None) -> DataFrame:
    """Records of a JSON file that is a list of them, or an object that holds them under ``holder``."""
    if holder is None:
        return spark.read.option("multiLine", True).option("encoding", "UTF-8").schema(schema).json(path)
    record = T.StructType.fromDDL(schema)
    whole = T.StructType([T.StructField(holder, T.ArrayType(record)), *record.fields])
    x = spark.read.option("multiLine", True).option("encoding", "UTF-8").schema(whole).json(path)
    alone = F.array(F.struct(*[F.col(f.name) for f in record.fields]))
    return x.select(F.explode(F.coalesce(F.col(holder), alone)).alias("r")).select("r.*")


def read_map(spark: SparkSession, path: str, holder: str = "terms") -> DataFrame:
    """(k, v) of a JSON object of terms; blank keys are dropped, keys and values trimmed."""
    schema = T.StructType([T.StructField(holder, T.MapType(T.StringType(), T.StringType()))])
    x = spark.read.option("multiLine", True).schema(schema).json(path)
    return x.select(F.explode(holder).alias("k", "v")).select(F.trim("k").alias("k"), F.trim("v").alias("v")).where("k <> ''")


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def first_available(*sources, empty_is_missing: bool = False) -> DataFrame:
    """The first source (a function without arguments) that can be read; for some stores an empty one counts as missing."""
    last: Exception | None = None
    for source in sources:
        try:
            df = source()
            if df is not None and not (empty_is_missing and df.isEmpty()):
                return df
        except Exception as error:  # noqa: BLE001  any failure to read means: try the next
            last = error
    raise LookupError("no source could be read") from last


def seeded(profiles: DataFrame, seeds: DataFrame, key: str = "name") -> DataFrame:
    """Profiles with blank fields filled from their seed, and the seeds that have no profile."""
    norm = lambda c: F.lower(F.trim(c))
    p, s = profiles.alias("p"), seeds.alias("s")
    fields = [c for c in profiles.columns if c != key]

    def filled(c: str) -> Column:
        kind = profiles.schema[c].dataType
        own = F.col(f"p.{c}")
        blank = F.size(own) <= 0 if isinstance(kind, (T.ArrayType, T.MapType)) else F.trim(own) == "" if isinstance(kind, T.StringType) else F.lit(False)
        return F.when(own.isNull() | blank, F.coalesce(F.col(f"s.{c}"), own)).otherwise(own).alias(c)

    cond = norm(F.col(f"p.{key}")) == norm(F.col(f"s.{key}"))
    return p.join(s, cond, "left").select(F.col(f"p.{key}").alias(key), *map(filled, fields)).unionByName(s.join(p, cond, "left_anti").select(key, *fields))


def _grams(text: Column) -> Column:
    """All runs of one to three characters."""
    at = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(at(1), at(2), at(3)))


def alias_lookup(names: DataFrame, profiles: DataFrame) -> DataFrame:
    """The profile of each spoken ``name``: by its key, else by substring of its name or by an alias; the first in store order.

    A name that is part of another one starts with one of its runs of three characters (or is
    shorter), so candidates meet by equal keys, whatever the size of the store."""
    asked = names.select("asked", F.lower(F.trim("asked")).alias("a")).distinct()
    own = profiles.select("seq", "name", F.lower(F.trim("name")).alias("o"))
    start = lambda c: F.substr(F.col(c), F.lit(1), F.lit(3))
    others = profiles.select("seq", "name", F.explode(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))).alias("a"))
    inside = asked.where("a != ''").withColumn("g", start("a")).join(own.withColumn("g", F.explode(_grams(F.col("o")))), "g").where(F.contains("o", "a"))
    around = asked.withColumn("g", F.explode(_grams(F.col("a")))).join(own.withColumn("g", start("o")), "g").where(F.contains("a", "o"))
    exact = asked.join(own, F.col("a") == F.col("o"))
    rank = F.when(F.col("a") == F.col("o"), 0).otherwise(1).alias("rank")
    met = inside.select("asked", rank, "seq", "name").unionByName(around.select("asked", rank, "seq", "name")).unionByName(exact.select("asked", rank, "seq", "name"))
    met = met.unionByName(others.where("a != ''").join(asked, "a").select("asked", F.lit(1).alias("rank"), "seq", "name"))
    best = met.groupBy("asked").agg(F.min(F.struct("rank", "seq", "name")).alias("m"))
    return names.join(best.select("asked", F.col("m.name").alias("profile")), "asked", "left")


def vocabulary(texts: DataFrame, column: str, least: int = 2) -> DataFrame:
    """Distinct upper-case words of at least ``least`` letters."""
    return texts.select(F.explode(F.regexp_extract_all(F.upper(column), F.lit(f"([A-Z]{{{least},}})"))).alias("word")).distinct()


def append(df: DataFrame, path: str, schema: str, defaults: dict | None = None) -> None:
    """Append records, cast to the store's schema, with defaults; columns that the store lacks are left out."""
    x = with_defaults(df, defaults or {})
    x.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in x.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema).fields]).write.mode("append").parquet(path)


def upserted(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The store after writing ``rows``: by lower-case trimmed key, later rows win; blank keys are refused.

    ``rows`` has ``seq`` for their order. The result is for a new place: parquet has no MERGE."""
    norm = lambda df: df.withColumn(key, F.lower(F.trim(F.col(key)))).where(F.col(key) != "")
    old = norm(store).withColumn("seq", F.lit(-1).cast("long"))
    both = old.unionByName(norm(rows), allowMissingColumns=True)
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))
    return both.withColumn("_r", newest).where("_r = 1").select(*store.columns)


def removed(pairs: DataFrame, key: str) -> DataFrame:
    """A dictionary without the first key that equals ``key`` in any letter case."""
    hit = pairs.where(F.lower("k") == key.lower()).agg(F.min("k").alias("k"))
    return pairs.join(F.broadcast(hit), "k", "left_anti")  # one row


def migrated(df: DataFrame, path: str, schema: str, defaults: dict | None = None) -> dict[str, int]:
    """Write a store to its table; rows that cannot be cast are counted and kept apart, not lost."""
    x = with_defaults(df, defaults or {})
    good, fields = None, T.StructType.fromDDL(schema).fields
    for f in fields:
        if f.name in x.columns:
            ok = F.col(f.name).isNull() | F.col(f.name).try_cast(f.dataType).isNotNull()
            good = ok if good is None else good & ok
    x = x.withColumn("_ok", good)
    x.where("_ok").select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in x.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]).write.mode("overwrite").parquet(path)
    x.where("not _ok").drop("_ok").write.mode("overwrite").json(f"{path}.refused")
    n = {bool(r["_ok"]): r["count"] for r in x.groupBy("_ok").count().collect()}
    return {"written": n.get(True, 0), "refused": n.get(False, 0)}
