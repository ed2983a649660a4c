"""Term stores and rule tables: policy, expansion, masking, enforcement, sound dictionary."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from leafmill.functions import sounds as sound
from leafmill.session import bounded

# Kinds of entries, methods, and which methods a kind may use.
ENTRY_TYPES = ("title", "character_name", "real_person", "term")
METHODS = ("meaning", "transliteration", "transliteration_override", "fixed")


def policy_violation(entry_type: Column, method: Column, reason: Column) -> Column:
    """The first rule that an entry breaks, or 'valid'."""
    blank = F.trim(F.coalesce(reason, F.lit(""))) == ""
    return (
        F.when(~F.coalesce(entry_type.isin(*ENTRY_TYPES), F.lit(False)), "invalid entry_type").when(~F.coalesce(method.isin(*METHODS), F.lit(False)), "invalid method")
        .when((entry_type == "title") & (method != "meaning"), "rule 1")
        .when((entry_type == "character_name") & ~method.isin("meaning", "transliteration_override"), "rule 2")
        .when((entry_type == "character_name") & (method == "transliteration_override") & blank, "rule 4")
        .when((entry_type == "real_person") & (method != "transliteration"), "rule 3")
        .when((entry_type == "term") & ~method.isin("fixed", "meaning"), "rule 5").otherwise("valid")
    )


def placeholder(term: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.upper(term), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit("XNAME_"), slug, F.lit("_X"))


def expanded_terms(terms: DataFrame) -> DataFrame:
    """One row a pattern: each term and its other names, with the term's placeholder, longest first.

    Places are counted within each length, and lengths are shifted by sums over one row a length, so
    that no task sees all patterns."""
    names = F.explode(F.array_distinct(F.concat(F.array("source_term"), F.coalesce("aliases", F.array().cast("array<string>")))))
    x = terms.select("seq", "source_term", "canonical", names.alias("name")).withColumn("size", F.length("name"))
    sizes = x.groupBy("size").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("size", F.coalesce(before, F.lit(0)).alias("before"))
    x = x.withColumn("inside", F.row_number().over(Window.partitionBy("size").orderBy("seq", "name"))).join(sizes, "size")
    return x.select("seq", "source_term", "canonical", "name", placeholder(F.col("source_term")).alias("placeholder"), (F.col("before") + F.col("inside")).cast("int").alias("place"))


def term_hash(pairs: DataFrame) -> DataFrame:
    """Eight hex digits over the sorted key:value pairs: changes whenever the dictionary does."""
    joined = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "k", "v"))), "|")
    return pairs.groupBy("kind").agg(F.substring(F.md5(joined), 1, 8).alias("hash"), F.count("*").alias("n"))


def folded(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered regular-expression rules, one after the other, inside of one projection."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def rule_function(rules: list[tuple[str, str]]):
    """A long table of ordered rules as one Arrow-batched function with patterns compiled once."""

    @pandas_udf(T.StringType())
    def apply(texts: pd.Series) -> pd.Series:
        compiled = [(re.compile(p, re.I), r) for p, r in rules]

        def one(text):
            for pattern, replacement in compiled:
                text = pattern.sub(replacement, text)
            return text

        return texts.map(one, na_action="ignore")

    return apply


def like_case(seen: str, wanted: str) -> str:
    """``wanted`` in the letter case of ``seen``: all capitals, all small, or a capital first."""
    if seen.isupper():
        return wanted.upper()
    if seen.islower():
        return wanted.lower()
    return wanted.capitalize() if seen[:1].isupper() else wanted


def case_keeping(rules: list[tuple[str, str]]):
    """An Arrow-batched function that applies (pattern, word) rules in order, each word in the case of what it replaces."""

    @pandas_udf(T.StringType())
    def apply(texts: pd.Series) -> pd.Series:
        compiled = [(re.compile(p, re.I), v) for p, v in rules]

        def one(text):
            for pattern, wanted in compiled:
                text = pattern.sub(lambda m, wanted=wanted: like_case(m[0], wanted), text)
            return text

        return texts.map(one, na_action="ignore")

    return apply


#: Letters of terms that one automaton holds; a larger dictionary is applied in parts, the longest terms first.
MOST_LETTERS = 20_000_000


def small(text: str) -> str:
    """``text`` in small letters, place by place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _word(text: str, i: int) -> bool:
    return 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")


class Dictionary:
    """Terms in an Aho-Corasick automaton: all whole-word matches of a text in one walk over it."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            if term not in self.automaton:  # the first of equal terms holds
                self.automaton.add_word(term, (i, len(term)))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, term) of the matches that stay, in order: longer terms first, then earlier
        terms, then places from left to right; what overlaps one that stays goes."""
        if not len(self.automaton):
            return []
        found = []
        for last, (i, n) in self.automaton.iter(text):
            a, b = last + 1 - n, last + 1
            if _word(text, a - 1) != _word(text, a) and _word(text, b - 1) != _word(text, b):
                found.append((-n, i, a, b))
        if len(found) > 1:
            found.sort()
        taken, out = bytearray(len(text)) if len(found) > 1 else None, []
        for _, i, a, b in found:
            if taken is not None:
                if any(taken[a:b]):
                    continue
                taken[a:b] = b"\1" * (b - a)
            out.append((a, b, i))
        return sorted(out)

    def replaced(self, text: str, low: str, word: Callable[[int, str], str]) -> str:
        """``text`` with ``word(term, what was there)`` for each match in ``low``."""
        parts, end = [], 0
        for a, b, i in self.matches(low):
            parts += [text[end:a], word(i, text[a:b])]
            end = b
        return "".join([*parts, text[end:]]) if parts else text


def _in_parts(terms: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """Terms, longest first, in parts of at most MOST_LETTERS letters."""
    parts, room = [[]], MOST_LETTERS
    for t in sorted(terms, key=lambda t: -len(t[0])):
        if len(t[0]) > room and parts[-1]:
            parts.append([])
            room = MOST_LETTERS
        parts[-1].append(t)
        room -= len(t[0])
    return parts


def _replacing(spark: SparkSession, terms: list[tuple[str, str]], fold: Callable[[str], str], word: Callable[[str, str], str]):
    """A function that replaces terms (in small letters) in texts, longest terms first.

    The automata are built once and broadcast, each of bounded size; a worker holds one copy. Texts
    come to it in batches of bounded bytes."""
    bounded(spark)
    parts = [(spark.sparkContext.broadcast((Dictionary([t for t, _ in part]), [w for _, w in part]))) for part in _in_parts(terms) if part]

    @pandas_udf(T.StringType())
    def apply(texts: pd.Series) -> pd.Series:
        held = [p.value for p in parts]

        def one(text):
            for dictionary, words in held:
                text = dictionary.replaced(text, fold(text), lambda i, seen, words=words: word(words[i], seen))
            return text

        return texts.map(one, na_action="ignore")

    return apply


def enforcement(glossary: dict[str, str], spark: SparkSession | None = None):
    """A function that puts the glossary's terms for its whole-word keys, longest key first, in the case found.

    Time goes with the text and what is found in it, not with the number of keys. What a
    replacement makes together with its neighbours is not looked at again."""
    items = [(small(k), v) for k, v in glossary.items() if k and v]
    return _replacing(spark or SparkSession.active(), items, small, lambda wanted, seen: like_case(seen, wanted))


def spellings(term: str) -> list[str]:
    """A term with each hyphen as it is, as a space, or left out."""
    out = [""]
    for i, part in enumerate(term.split("-")):
        out = [o + mark + part for o in out for mark in (["-", " ", ""] if i else [""])]
    return out


def blanks(text: str) -> str:
    """Small letters, and any white space as a space."""
    return re.sub(r"\s", " ", small(text))


# How placeholders come back from translation, and the names they stood for; names that
# translation and reading spoil, and how they are written.
MUTATED = [(r"XNAME_M[AJ]Y?OR[A-Z0-9_]*_X", "Mer J. Jona Jeymson"), (r"XNAME_SPIDER[A-Z0-9_]*_X", "O'rgimchak-Odam"), (r"XNAME_OCTAVIUS[A-Z0-9_]*_X", "Otto Oktavius"), (r"XNAME_DOCTOR_OCTOPUS[A-Z0-9_]*_X", "Doktor Oktopus")]
SPOILED = [(r"\bJamison\b", "Jeymson"), (r"\bJeymison\b", "Jeymson"), (r"\bGoldamon\b", "Goldman"), (r"\bGoldmanmanman\b", "Goldman"), (r"\bRuta\s+Goldman\b", "Rut Goldman"), (r"\bJonasi\b", "Jona"), (r"\bJonay\b", "Jona"), (r"\bXotiriq\b", "Xotira"), (r"\bO['’]?rgimchak[\-\s](?:yigit|bola|odam)\b", "O'rgimchak-Odam")]


def masking(terms: list[tuple[str, str]], spark: SparkSession | None = None):
    """(mask, unmask) functions: names become placeholders that translation leaves alone, and back.

    A hyphen of a name may be a space or missing. Back come first the placeholders as they were,
    in any case, then those that translation has changed, then names that it has spoilt."""
    mask = _replacing(spark or SparkSession.active(), [(s, p) for n, p in terms for s in dict.fromkeys(spellings(blanks(n)))], blanks, lambda mark, seen: mark)

    @pandas_udf(T.StringType())
    def unmask(texts: pd.Series, canonical: pd.Series) -> pd.Series:
        changed = [(re.compile(p, re.I), v) for p, v in (*MUTATED, *SPOILED)]

        def one(text, back):
            back = dict(back)
            text = re.sub(r"XNAME_[A-Z0-9_]+?_X", lambda m: back.get(m[0].upper(), m[0]), text, flags=re.I)
            for pattern, name in changed:
                text = pattern.sub(name, text)
            return text

        return pd.Series([None if t is None else one(t, b) for t, b in zip(texts, canonical)], dtype=object)

    return mask, unmask


def sound_matches(words: DataFrame, sounds: DataFrame) -> DataFrame:
    """Words that are sound effects, as they are or with drawn-out letters: (id, word, kind, confidence in percent).

    ``sounds`` (name, kind, rank, sure) is a dictionary of fixed size; of several kinds the lowest
    rank counts. A drawn-out match has 95 at most, and is only tried with entries that have a kind
    (sure of 0.99). Words are looked up once each, however often they occur."""
    once = words.select("word").distinct().withColumn("core", sound.core_of(F.col("word"))).withColumn("key", sound.letters_of(F.col("core")))
    once = once.where((F.col("key") != "") & ~F.col("key").isin(*sound.SPOKEN))
    met = once.withColumn("form", F.explode(sound.forms(F.col("core")))).join(F.broadcast(sounds), F.col("form") == F.col("name"))
    exact, sure = (F.col("form") == F.col("key")) | (F.col("form") == F.col("core")), F.round(100 * F.col("sure")).cast("int")
    met = met.where(exact | (sure >= 99)).withColumn("confidence", F.when(exact, sure).otherwise(F.least(sure, F.lit(95))))
    best = met.groupBy("word").agg(F.min(F.struct("rank", (-F.col("confidence")).alias("neg"), "kind")).alias("m"))
    return words.join(best, "word").select("id", "word", F.col("m.kind").alias("kind"), (-F.col("m.neg")).alias("confidence"))


#: Tokens of items that tasks hold as an index.
MOST_POSTINGS = 2_000_000


def token_overlaps(docs: DataFrame, items: DataFrame, step: int = 256) -> DataFrame:
    """(doc_id, item_id, shared, together) of each document (doc_id, ts) and item (item_id, bs) with a common token.

    ``ts`` and ``bs`` hold distinct tokens. Up to MOST_POSTINGS tokens of items, every task has them
    as an inverted index, and the common tokens of a pair are counted over its postings; more items
    are joined token by token."""
    size = items.agg(F.coalesce(F.sum(F.size("bs")), F.lit(0)).alias("n")).first()["n"]
    if size > MOST_POSTINGS:
        a, b = docs.select("doc_id", F.size("ts").alias("n_a"), F.explode("ts").alias("token")), items.select("item_id", F.size("bs").alias("n_b"), F.explode("bs").alias("token"))
        met = a.join(b, "token").groupBy("doc_id", "item_id", "n_a", "n_b").agg(F.count("*").alias("shared"))
        return met.select(F.col("doc_id").cast("long"), F.col("item_id").cast("long"), "shared", (F.col("n_a") + F.col("n_b") - F.col("shared")).cast("long").alias("together"))
    held = items.select("item_id", "bs").collect()
    n = len(held)
    postings: dict[str, list[int]] = {}
    for i, row in enumerate(held):
        for token in row["bs"]:
            postings.setdefault(token, []).append(i)
    vocabulary = pa.array(list(postings), pa.string())
    sizes = np.array([len(row["bs"]) for row in held], np.int64)
    item_ids = np.array([row["item_id"] for row in held], np.int64)
    many = np.array([len(x) for x in postings.values()], np.int64)
    item = np.array([i for x in postings.values() for i in x], np.int64)
    start = np.cumsum(many) - many

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows if n else 0, step):
                part = batch.slice(a, step)
                ts = part.column(1)
                own = pc.list_value_length(ts).to_numpy().astype(np.int64)
                place = pc.index_in(ts.flatten(), value_set=vocabulary).fill_null(-1).to_numpy()
                row = np.repeat(np.arange(part.num_rows), own)[place >= 0]
                place = place[place >= 0]
                count = many[place]
                at = np.repeat(start[place] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                shared = np.bincount(np.repeat(row, count) * n + item[at], minlength=part.num_rows * n)
                met = np.flatnonzero(shared)
                shared, doc, other = shared[met], met // n, met % n
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(item_ids[other]), pa.array(shared), pa.array(own[doc] + sizes[other] - shared)], ["doc_id", "item_id", "shared", "together"])

    return docs.select(F.col("doc_id").cast("long"), "ts").mapInArrow(run, "doc_id long, item_id long, shared long, together long")


def entities(text: Column) -> Column:
    """Runs of two or more capitalised words."""
    return F.regexp_extract_all(text, F.lit("(?U)\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+)\\b"))


def new_terms(candidates: DataFrame, known: DataFrame) -> DataFrame:
    return candidates.join(known, F.lower("candidate") == F.col("source_term"), "left_anti").select("candidate").distinct()
