"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

The projection counts everything a rule needs (words, symbols, stop words, lines, repeats) once
a text and then compares each ratio with its bounds. No shuffle, no user function.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import let

WINDOW = 8
SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is it for was as on are this by from at an or not a "
    "der die das und zu den mit von für auf ist im nicht ein eine als auch sich es dem "
    "le la les de des et en un une du que est dans pour qui sur au par il plus pas "
    "el los las y una por con para del se no al lo como su más"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high``; it holds for any text without denominator."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


#: Bounds lie far outside of what plain prose has, so that clean documents stay.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=2.5, high=14.0),
    Rule("symbols_per_word", "n_symbols", "n_words", high=0.2),
    Rule("words_with_letters", "n_letter_words", "n_words", low=0.7),
    Rule("stop_words", "n_stop_words", "n_words", low=0.03),
    Rule("capital_letters", "n_capitals", "word_chars", high=0.3),
    Rule("echoed_words", "n_echo_words", "n_words", high=0.2),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.4),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more in the text.

    Windows are compared by a 64-bit hash. Only texts with a window that occurs twice sort."""
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))

    def covered(found: Column) -> Column:
        def starts(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"]))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        ordered = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        total = F.aggregate(let(ordered, starts), zero, lambda a, p: F.struct((a["n"] + (p + WINDOW - F.greatest(a["end"], p))).alias("n"), (p + WINDOW).alias("end")))
        return F.when(F.size(F.array_distinct(found)) < F.size(found), total["n"]).otherwise(F.lit(0).cast("long"))

    return let(hashes, covered)


def measures(text: Column) -> Column:
    """A struct of all counts of a text; null counts as a text without words."""
    whole = F.coalesce(text, F.lit(""))

    def lines(found: Column) -> Column:
        return F.struct(F.size(found).cast("long").alias("n"), (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("dup"))

    def counted(words: Column) -> Column:
        n = F.size(words)
        bare = lambda w: F.lower(F.regexp_replace(w, "[.,;:!?]+$", ""))
        return F.struct(
            n.cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
            _repeat_words(words, n).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: bare(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.size(F.filter(words, lambda w: w.rlike("\\p{L}"))).cast("long").alias("n_letter_words"),
            F.size(F.filter(words, lambda w, i: F.get(words, i - 1).eqNullSafe(w))).cast("long").alias("n_echo_words"),
        )

    words = F.filter(F.split(whole, SPACE), lambda w: w != "")
    kept_lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return F.struct(
        let(words, counted).alias("w"),
        let(kept_lines, lines).alias("l"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(whole, "[^A-ZÀ-ÖØ-Þ]+", "")).cast("long").alias("n_capitals"),
    )


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Judge each whole text of ``docs`` (doc_id, text) by the table of ``rules``.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed
    (under 20 words, or over 30 % of the words in repeated windows), kept (not base_failed and
    every rule holds) and ``failed``, the names of the rules that don't hold.

    A null or empty text has no words, so it fails the base rule. Null ids and repeated rows are
    judged each for itself; whole texts count, however long; other columns are left out; no rows
    give none."""
    return _judged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rules).select("doc_id", *VERDICT)


VERDICT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


NAMES = ("n_words", "word_chars", "n_repeat_words", "n_stop_words", "n_letter_words", "n_echo_words")


def _base_failed(of) -> Column:
    return (of("n_words") < MIN_WORDS) | (100 * of("n_repeat_words") > MAX_REPEAT_PERCENT * of("n_words"))


def _judged(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The columns of ``docs``, then all counts and the verdict."""
    flat = docs.withColumn("m", measures(F.col("text")))
    flat = flat.select(*docs.columns, "m.w.*", "m.n_symbols", "m.n_capitals", F.col("m.l.n").alias("n_lines"), F.col("m.l.dup").alias("n_dup_lines"))
    base = _base_failed(F.col)
    failed = F.array_compact(F.array(*[F.when(_broken(r, F.col), F.lit(r.name)) for r in rules]))
    return flat.withColumn("base_failed", base).withColumn("failed", failed).withColumn("kept", ~base & (F.size(failed) == 0))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns; one narrow pass.

    The verdict is one expression over the struct of counts, bound once: a filter on columns
    taken out of that struct would be pushed below them and count anew for each reference.
    Null and empty texts fail the base rule; repeated rows are judged each; no rows give none."""

    def verdict(m: Column) -> Column:
        def of(name: str) -> Column:
            if name in ("n_lines", "n_dup_lines"):
                return m["l"]["n" if name == "n_lines" else "dup"]
            return m["w"][name] if name in NAMES else m[name]

        bad = _base_failed(of)
        for rule in rules:
            bad = bad | _broken(rule, of)
        return ~bad

    return docs.where(let(measures(F.col("text").cast("string")), verdict))


def _broken(rule: Rule, of) -> Column:
    top, bottom = of(rule.numerator), of(rule.denominator)
    out = F.lit(False)
    if rule.low is not None:
        out = out | (top < rule.low * bottom)
    if rule.high is not None:
        out = out | (top > rule.high * bottom)
    return out


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same result as DuckDB SQL."""
    broken = []
    for r in rules:
        parts = [f"{r.numerator} < CAST({r.low} AS DOUBLE) * {r.denominator}"] * (r.low is not None) + [f"{r.numerator} > CAST({r.high} AS DOUBLE) * {r.denominator}"] * (r.high is not None)
        broken.append(f"CASE WHEN {' OR '.join(parts)} THEN '{r.name}' END")
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
i AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - {WINDOW - 2}), lambda i: {{'i': i, 'g': array_to_string(ws[i:i + {WINDOW - 1}], ' ')}})) AS x FROM w WHERE len(ws) >= {WINDOW}),
g AS (SELECT doc_id, x.i AS i, count(*) OVER (PARTITION BY doc_id, x.g) AS n FROM i),
d AS (SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS c FROM g WHERE n > 1),
r AS (SELECT doc_id, sum(c) AS c FROM d GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS n_capitals,
        len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words,
        len(list_filter(ws, lambda x: regexp_matches(x, '\\pL'))) AS n_letter_words,
        len(list_filter(ws, lambda x: lower(regexp_replace(x, '[.,;:!?]+$', '')) IN ({stops}))) AS n_stop_words,
        len(list_filter(range(2, len(ws) + 1), lambda k: ws[k] = ws[k - 1])) AS n_echo_words
      FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
        list_filter([{', '.join(broken)}], lambda x: x IS NOT NULL) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND len(failed) = 0 AS kept, failed FROM f"""
