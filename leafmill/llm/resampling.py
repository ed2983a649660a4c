"""Importance resampling of documents towards the words of a target corpus.

Each task walks its texts through a trie of words. A node stands for a run of words and holds how
often the run was met and the CRC of its bytes, which goes on from the state of the node before it
(a space and the next word), so that no run is ever put together. Only bucket totals leave a task.
With the totals of both corpora the gain of each bucket is known; in the second walk a node holds
the gain of its bucket, and a document's weight is the sum of what it walks over.

The draw is that of the largest keys (weight plus Gumbel noise from a hash of the id): one range
sort, whose positions become ranks by the sizes of the sorted parts before them.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import bounded, delete_written, quoted, slices, utf8_bytes, written

#: Nodes of a trie before it is emptied (into the totals) and grown anew.
MOST_NODES = 300_000
#: Small letters for A-Z, spaces for all other ASCII characters but digits.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


class _Level(dict):
    """Words under their parent nodes; what is looked up and missing becomes a node."""

    def __init__(self, trie: "WordTrie", first: bool):
        self.trie, self.first = trie, first

    def __missing__(self, key) -> int:
        states = self.trie.states
        state = zlib.crc32(key) if self.first else zlib.crc32(key[1], zlib.crc32(b" ", states[key[0]]))
        node = self[key] = len(states)
        states.append(state)
        return node


class WordTrie:
    """Runs of up to ``most`` words; node numbers index ``states``, the CRCs of their runs."""

    def __init__(self, most: int):
        self.states: list[int] = []
        self.levels = [_Level(self, not i) for i in range(most)]

    def clear(self) -> None:
        self.states.clear()
        for level in self.levels:
            level.clear()

    def walk(self, words: list[bytes]) -> list[int]:
        """The nodes of all runs: those of one word first, then those of two, ..."""
        nodes = list(map(self.levels[0].__getitem__, words))
        out = nodes
        for k, level in enumerate(self.levels[1:], 1):
            nodes = list(map(level.__getitem__, zip(nodes, words[k:])))
            out = out + nodes
        return out


def _walks(part: pa.RecordBatch, column: int, trie: WordTrie):
    """(words, node numbers) of each text of a slice."""
    data, borders = utf8_bytes(part.column(column))
    plain = data.tobytes().translate(PLAIN)
    at = borders.tolist()
    for a, b in zip(at, at[1:]):
        words = plain[a:b].split()
        yield len(words), trie.walk(words)


def _totals(most: int, buckets: int):
    def run(batches):
        total, trie, count = np.zeros(buckets, np.int64), WordTrie(most), np.zeros(0, np.int64)

        def empty():
            np.add.at(total, np.array(trie.states, np.int64) % buckets, count)

        for batch in batches:
            for part in slices(batch, 0, between=40_000_000):
                for _, nodes in _walks(part, 0, trie):
                    if nodes:
                        new = np.bincount(nodes, minlength=len(trie.states))
                        new[: len(count)] += count
                        count = new
                    if len(trie.states) > MOST_NODES:
                        empty()
                        trie.clear()
                        count = np.zeros(0, np.int64)
        empty()
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    return run


def bucket_totals(texts: DataFrame, most: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many runs of 1 to ``most`` words of column text fall into each bucket."""
    bounded(texts.sparkSession)
    parts = texts.select(F.col("text").cast("string")).mapInArrow(_totals(most, buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each of the B buckets, in doubles."""
    n = len(source)
    s_all, t_all = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def _scored(most: int, gain: np.ndarray):
    def run(batches):
        trie, held = WordTrie(most), np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, 1, between=40_000_000):
                n_words, n_runs, weight = [], [], []
                for n, nodes in _walks(part, 1, trie):
                    if len(trie.states) > len(held):  # attach gains to the new nodes
                        held = np.concatenate([held, gain[np.array(trie.states[len(held) :], np.int64) % len(gain)]])
                    n_words.append(n)
                    n_runs.append(len(nodes))
                    weight.append(int(held[nodes].sum()) if nodes else 0)
                    if len(trie.states) > MOST_NODES:
                        trie.clear()
                        held = np.zeros(0, np.int64)
                columns = [part.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_runs, weight))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    return run


def resample(docs: DataFrame, target: DataFrame, *, most: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """Draw the documents of ``docs`` (doc_id, text) most like the texts of ``target`` (text).

    Words are lower-cased (A-Z only) runs of ASCII letters, digits and characters beyond ASCII. Returns
    each document's doc_id, n_features, weight, score (weight plus noise) and rank: 1, 2, 3, ... for
    the floor(``percent`` * N / 100) best of the N documents with ``least_words`` words or more, ties
    to smaller ids; null for the others.

    A null or empty text has no features and weight 0. A null id hashes like an empty one and
    comes last among ties. Repeated rows count, and are ranked, each for itself. Whole texts
    count, however long. Without target texts the gains tell rare buckets from frequent ones;
    without documents there are no rows. Other columns of either table are left out."""
    spark = docs.sparkSession
    gain = gains(bucket_totals(docs, most, buckets), bucket_totals(target, most, buckets))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.mapInArrow(_scored(most, gain), "doc_id long, n_words long, n_features long, weight long")
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digits, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    scored = rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform))))
    eligible = F.col("n_words") >= least_words
    # the sorted order of the eligible ones; a row's place among its part is in the low bits of ``at``
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    table = written(scored, "scored")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = table.where(eligible).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = written(ordered.withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("at", 33)
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).count().withColumnRenamed("count", "n").collect())  # a row a part
    drawn = sum(n for _, n in sizes) * percent // 100
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    starts = spark.createDataFrame(before, "part long, before long")
    ranked = placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1)
    names = ["doc_id", "n_features", "weight", "score"]
    ranked = ranked.select(*names, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    out = ranked.unionByName(table.where(~eligible).select(*names, F.lit(None).cast("long").alias("rank")))
    done = written(out, "resampled")
    delete_written(table, placed)
    return done


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; options and odd rows as in ``resample``.

    Rows that share an id are drawn together, when the first of them is; null ids never are."""
    ids = resample(docs, target, **options).where("rank is not null and doc_id is not null").select(F.col("doc_id").alias("drawn_id")).distinct()
    met = docs.select(F.struct(*quoted(docs)).alias("doc")).join(ids.hint("merge"), F.col("doc.doc_id") == F.col("drawn_id"), "left_semi")
    return met.select(*[F.col(f"doc.`{c}`") for c in docs.columns])


def oracle(buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024") -> str:
    """The same result as DuckDB SQL, for runs of one word; CRC by its table of 256 remainders."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    step = "CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END"
    words = lambda table: f"SELECT {'doc_id, rid, ' * (table == 'd')}unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM {table}"
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS text FROM documents),
b AS (SELECT translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS text FROM benchmark),
r AS (SELECT i, CAST(i AS BIGINT) AS a, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, {step}, k + 1 FROM r WHERE k < 8),
tab AS (SELECT list(a ORDER BY i) AS l FROM r WHERE k = 8),
dw AS ({words('d')}), bw AS ({words('b')}),
u AS (SELECT DISTINCT w, hex(w) AS h FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
v AS (SELECT w, list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))) AS bytes FROM u),
x AS (SELECT w, xor(list_reduce(bytes, lambda a, c: xor(a // 256, l[(xor(a, c) & 255) + 1])), 4294967295) % {buckets} AS bucket FROM v, tab),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN x USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM bw JOIN x USING (w) GROUP BY bucket),
g AS (SELECT s.bucket, floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM s) + {buckets})::DOUBLE
        / (CAST(s.n + 1 AS DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t) + {buckets})::DOUBLE))) AS gain FROM s LEFT JOIN t USING (bucket)),
y AS (SELECT rid, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN x USING (w) JOIN g USING (bucket) GROUP BY rid),
z AS (SELECT doc_id, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN y USING (rid)),
e AS (SELECT doc_id, n, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM z),
o AS (SELECT *, CASE WHEN n >= {least_words} THEN row_number() OVER (PARTITION BY n >= {least_words} ORDER BY score DESC, doc_id) END AS place,
        count(*) FILTER (WHERE n >= {least_words}) OVER () AS eligible FROM e)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CAST(CASE WHEN place <= eligible * {percent} // 100 THEN place END AS BIGINT) AS rank FROM o"""
