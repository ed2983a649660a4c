"""Toxicity by multiple-instance learning: a document is as toxic as its sentences make it.

A sentence with known runs of letters scores p = sigmoid(bias + sum of weights); a
document's score is the noisy-or of its sentences, 1 - (1 - leak) * prod(1 - p), where the leak
stands for what no sentence tells. (So a long text without evidence scores like a short one.) Only
documents have labels, so weights are fitted through the noisy-or: its log of "no sentence is
toxic" is a sum over sentences, whose gradient gives each sentence its share of the document's
label. The same weights then name the sentences that a score comes from.

The classifier is fitted on a bounded sample of labelled rows; scoring is one narrow pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import bounded, delete_written, slices, utf8_bytes, written

#: Labelled documents that are looked at, the smallest hashes of their ids first: toxic ones, clean ones.
FIT_TOXIC, FIT_CLEAN = 10_000, 20_000
#: Features that get weights, and the bits of the buckets that choose them.
FEATURES, BITS = 1024, 22
#: A feature must stand in so many sampled toxic documents, and tell the labels apart by so many
#: standard deviations of chance.
LEAST_TOXIC, LEAST_Z = 3, 4.0
#: Features are runs of so many bytes of the lower-case text, at most 8, all but letters as spaces.
RUNS = (4, 6, 8)
PAD = " " * max(RUNS)
#: Spaces for ASCII characters that are no letters; other bytes stay.
LETTERS = np.array([c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)
ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])
MIX = np.uint64(0x9E3779B97F4A7C15)  # spreads runs over buckets: 2**64 by the golden ratio


class Texts:
    """The texts of a slice as one array of bytes: lower-case, padded, with the ends of sentences."""

    def __init__(self, column: pa.Array):
        low = pc.utf8_lower(pc.fill_null(column, ""))
        self.raw, self.borders = utf8_bytes(pc.binary_join_element_wise(PAD, low, PAD, ""))
        ends = ENDS[self.raw]
        ends[self.borders[1:] - 1] = True
        #: places of the last bytes of sentences
        self.ends = np.flatnonzero(ends)

    def runs(self):
        """For each length, the run of bytes at each place as a number (0 where the texts end)."""
        plain, n = LETTERS[self.raw].astype(np.uint64), len(self.raw)
        whole = plain.copy()
        for k in range(1, max(RUNS)):
            whole[: n - k] |= plain[k:] << np.uint64(8 * k)
            if k + 1 in RUNS:
                yield whole.copy() if k + 1 < max(RUNS) else whole

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.borders, place, "right") - 1

    def span(self, sentence: int) -> tuple[int, int]:
        """(start, end) of a sentence in characters of its text."""
        end = int(self.ends[sentence]) + 1
        start = int(self.ends[sentence - 1]) + 1 if sentence else 0
        doc = int(self.document(np.array([end - 1]))[0])
        whole, pad = (self.raw[self.borders[doc] : self.borders[doc + 1]] & 0xC0) != 0x80, len(PAD)
        chars = lambda place: int(np.clip(whole[: place - self.borders[doc]].sum() - pad, 0, whole.sum() - 2 * pad))
        return chars(start), chars(end)


def buckets(runs: np.ndarray) -> np.ndarray:
    return (runs * MIX) >> np.uint64(64 - BITS)


class Known:
    """The chosen runs: where they stand in texts."""

    def __init__(self, features: list[int]):
        self.values = np.array(sorted(features), np.uint64)
        self.some = np.zeros(1 << BITS, bool)
        self.some[buckets(self.values)] = True

    def hits(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, feature) pairs, in order, each once; a run is in the sentence it begins in."""
        places, found = [], []
        for runs in texts.runs():
            at = np.flatnonzero(self.some[buckets(runs)])
            own = np.searchsorted(self.values, runs[at])
            same = np.flatnonzero(self.values[np.minimum(own, len(self.values) - 1)] == runs[at]) if len(self.values) else at[:0]
            places.append(at[same])
            found.append(own[same])
        sentence = np.searchsorted(texts.ends, np.concatenate(places))
        both = np.unique(sentence * FEATURES + np.concatenate(found))
        return both // FEATURES, both % FEATURES


def _counted(batches):
    """How many texts of either label hold a bucket, per task."""
    held, first = np.zeros((2, 1 << BITS), np.int64), np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for part in slices(batch, 0):
            texts, labels = Texts(part.column(0)), part.column(1).to_pylist()
            found = [buckets(x).astype(np.int32) for x in texts.runs()]
            for toxic, a, b in zip(labels, texts.borders.tolist(), texts.borders[1:].tolist()):
                own = np.concatenate([x[a:b] for x in found])
                order = np.arange(len(own))
                first[own] = order  # each bucket once: where the last of its runs stands
                held[toxic][own[first[own] == order]] += 1
    met = np.flatnonzero(held.any(0))
    for lo in range(0, len(met), 100_000):
        some = met[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[1][some]), pa.array(held[0][some])], ["bucket", "toxic", "clean"])


def _runs_in(chosen: np.ndarray):
    """The runs of chosen buckets and how often they stand in toxic texts, per slice."""

    def run(batches):
        some = np.zeros(1 << BITS, bool)
        some[chosen] = True
        for batch in batches:
            for part in slices(batch, 0):
                for runs in Texts(part.column(0)).runs():
                    values, n = np.unique(runs[some[buckets(runs)]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(buckets(values).astype(np.int64)), pa.array(values.view(np.int64)), pa.array(n)], ["bucket", "run", "n"])

    return run


def _patterns(features: list[int]):
    """The features of each sentence that has some, by text."""

    def run(batches):
        known = Known(features)
        for batch in batches:
            for part in slices(batch, 0):
                texts = Texts(part.column(0))
                sentence, feature = known.hits(texts)
                held: list = [[] for _ in range(part.num_rows)]
                cuts = np.flatnonzero(np.diff(sentence)) + 1
                if len(sentence):
                    docs = texts.document(texts.ends[sentence[np.concatenate([[0], cuts])]])
                    for doc, own in zip(docs.tolist(), np.split(feature, cuts)):
                        held[doc].append(own.tolist())
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(held, pa.list_(pa.list_(pa.int32())))], ["toxic", "held"])

    return run


@dataclass
class NoisyOr:
    """The runs that are features, in order, their weights, the bias of a sentence, -log(1 - leak)."""

    features: list[int]
    weights: np.ndarray
    bias: float
    leak: float


def fit(toxic: np.ndarray, held: list[list[list[int]]], importance: np.ndarray, features: int, *, turns: int = 400, decay: float = 1e-4) -> tuple[np.ndarray, float, float]:
    """(weights, bias, leak) by gradient descent with adaptive steps (Adam), all documents a turn.

    ``toxic``, ``importance`` and ``held`` (the features of its sentences) go by document. With S
    the leak plus the sum over sentences of -log(1 - p), P(clean) = exp(-S); the loss is
    -log P(label) plus ``decay`` times half the squares of the weights."""
    doc = np.array([d for d, own in enumerate(held) for _ in own], np.int64)
    flat = np.array([f for own in held for s in own for f in s], np.int64)
    sentence = np.repeat(np.arange(len(doc)), [len(s) for own in held for s in own])
    share = importance / importance.sum()
    x = np.concatenate([np.full(features, 1.0), [-3.0, -4.0]])  # weights, bias, log-odds of the leak
    m, v = np.zeros(len(x)), np.zeros(len(x))
    for turn in range(1, turns + 1):
        z = x[-2] + np.bincount(sentence, x[flat], len(doc))
        s = np.logaddexp(0, x[-1]) + np.bincount(doc, np.logaddexp(0, z), len(toxic))
        slope = share * np.where(toxic == 1, 1 / -np.expm1(np.minimum(s, 500)), 1.0)  # of the loss by S
        each = slope[doc] * np.exp(-np.logaddexp(0, -z))
        g = np.concatenate([np.bincount(flat, each[sentence], features) + decay * x[:-2], [each.sum(), slope.sum() / (1 + np.exp(-x[-1]))]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - 0.1 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-9)
    return x[:-2], float(x[-2]), float(np.logaddexp(0, x[-1]))


def held_out(doc_id):
    """Whether a row's labels are kept back: crc32 of the id as text, modulo 3, is 1; never of null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> NoisyOr | None:
    """Fit on labelled documents that are not held out; None without labels of both kinds.

    Up to FIT_TOXIC toxic and FIT_CLEAN clean labelled rows are taken, by a hash of their ids, and
    weighed back to their shares. Of labels that differ for one id, toxic holds; null labels and
    ids, and ids without a document, tell nothing."""
    spark = docs.sparkSession
    bounded(spark)
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = written(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labels")
    shares = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    taken = [known.where(F.col("toxic") == k).orderBy(*order).limit(n) for k, n in ((1, FIT_TOXIC), (0, FIT_CLEAN))]
    asked = taken[0].union(taken[1]).withColumnRenamed("doc_id", "asked")  # bounded, so it can be broadcast
    sample = docs.select(F.col("doc_id").cast("long").alias("asked"), F.col("text").cast("string")).join(F.broadcast(asked), "asked").select("text", "toxic")
    sample = written(sample, "sample")
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    model = None
    if len(n) == 2:
        counts = sample.mapInArrow(_counted, "bucket long, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        gap = F.col("toxic") / n[1] - F.col("clean") / n[0]
        both = (F.col("toxic") + F.col("clean")) / (n[1] + n[0])
        z = gap / F.sqrt((both * (1 - both) + 1e-9) * (1 / n[1] + 1 / n[0]))
        best = counts.where((F.col("toxic") >= min(LEAST_TOXIC, n[1])) & (z >= LEAST_Z)).orderBy(z.desc(), "bucket").limit(FEATURES)
        chosen = np.array([r.bucket for r in best.select("bucket").collect()], np.int64)
        runs = sample.where("toxic = 1").mapInArrow(_runs_in(chosen), "bucket long, run long, n long").groupBy("bucket", "run").agg(F.sum("n").alias("n"))
        runs = runs.groupBy("bucket").agg(F.max_by("run", F.struct("n", "run")).alias("run"))  # the commonest of each bucket
        features = sorted(r.run & 0xFFFFFFFFFFFFFFFF for r in runs.collect())
        rows = sample.mapInArrow(_patterns(features), "toxic int, held array<array<int>>").collect()  # of the bounded sample
        rows.sort(key=lambda r: (r.toxic, r.held))  # sums must not go by the order of tasks
        toxic = np.array([r.toxic for r in rows], np.int64)
        importance = np.where(toxic == 1, shares[1] / n[1], shares[0] / n[0])
        model = NoisyOr(features, *fit(toxic, [r.held for r in rows], importance, len(features)))
    delete_written(known, sample)
    return model


def _scored(model: NoisyOr | None):
    def run(batches):
        known = Known(model.features if model else [])
        for batch in batches:
            for part in slices(batch, 1, between=40_000_000):
                score, offending = np.zeros(part.num_rows), [[] for _ in range(part.num_rows)]
                if model:
                    texts = Texts(part.column(1))
                    sentence, feature = known.hits(texts)
                    numbers, own = np.unique(sentence, return_inverse=True)
                    z = model.bias + np.bincount(own, model.weights[feature], len(numbers))
                    docs = texts.document(texts.ends[numbers])
                    score = -np.expm1(-model.leak - np.bincount(docs, np.logaddexp(0, z), part.num_rows))
                    for i in np.flatnonzero(z >= 0).tolist():
                        a, b = texts.span(int(numbers[i]))
                        offending[docs[i]].append({"start": a, "end": b})
                spans = pa.array(offending, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), spans], ["doc_id", "score", "offending"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """Score each whole text of ``docs`` (doc_id, text), learning from ``labels`` (doc_id, toxic).

    Returns doc_id, held_out (its label, if any, was not learned from), score (0 to 1), predicted
    (1 if score >= ``threshold``) and offending, the (start, end) characters of the sentences that
    are toxic more likely than not.

    A null or empty text has no sentences and scores the leak, as does any text without evidence,
    however long. Null ids are never held out. Repeated rows are scored each for itself, and equal
    texts alike. Without learnable labels of both kinds all scores are 0; no documents give no
    rows. Only id and text of documents, id and toxic of labels are read, whatever else there is."""
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = rows.mapInArrow(_scored(model), "doc_id long, score double, offending array<struct<start:int,end:int>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending")
