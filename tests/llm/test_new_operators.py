"""Toxicity, importance resampling and vector codes against plain restatements."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafmill.llm import queries, resampling, toxicity, vectorcodes

NUMBERED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def runs(text, most):
    w = NUMBERED.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)], len(w)


def resampled(rows, targets, most=1, buckets=10_000, percent=10, least=20):
    """(doc_id, n_features, weight, score, rank) of each row."""
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = (Counter(bucket(x) for text in texts for x in runs(text, most)[0]) for texts in ([r[1] for r in rows], targets))
    S, T = s.total() + buckets, t.total() + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * S / ((s[b] + 1) * T)))
    out = []
    for doc, text in rows:
        found, words = runs(text, most)
        weight = sum(gain(bucket(x)) for x in found)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    eligible = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(eligible[: len(eligible) * percent // 100]):
        r.append(k + 1)
    return sorted((tuple(r[:4] + (r[5:] or [None])) for r in out), key=str)


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(3)
    words = "Alpha beta GAMMA delta 42 éclair Ünder 中文 x-y don't".split()
    some = [" ".join(rng.choice(words) for _ in range(rng.randint(15, 60))) for _ in range(40)]
    return [None, "", " \n", "one", *some, some[0], "w" * 100_000, " ".join(f"n{i}" for i in range(5000))]


@pytest.mark.parametrize("most, nodes", [(1, 300_000), (1, 50), (3, 300_000), (3, 1)])
def test_resampling(spark, odd_texts, most, nodes, monkeypatch):
    rows = [(i * 7 + 1, t) for i, t in enumerate(odd_texts)] + [(1, None), (8, "again " * 30), (8, "again " * 30), (None, "no id " * 30)]
    targets = ["alpha beta beta", None, "éclair 42 n7"]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, weight int, rank int")
    target = spark.createDataFrame([(t, 5) for t in targets], "text string, doc_id int")
    # a trie that is emptied again and again gives the same totals
    small = resampling.WordTrie
    monkeypatch.setattr(resampling, "MOST_NODES", nodes)
    assert small is resampling.WordTrie
    got = resampling.resample(docs, target, most=most, percent=30).collect()
    assert sorted(map(tuple, got), key=str) == resampled(rows, targets, most=most, percent=30)


def test_tries_are_emptied_in_place():
    """Within one task: texts after an emptying go on with the new tries."""
    import numpy as np
    import pyarrow as pa

    texts = [" ".join(f"w{(i * 31 + j) % 977}" for j in range(200)) for i in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(texts)], ["doc_id", "text"])
    gain = np.arange(1000) - 300
    want_totals, want = Counter(), []
    for t in texts:
        b = [zlib.crc32(x.encode()) % 1000 for x in runs(t, 2)[0]]
        want_totals.update(b)
        want.append(sum(int(gain[x]) for x in b))
    before = resampling.MOST_NODES
    resampling.MOST_NODES = 250
    try:
        (totals,) = resampling._totals(2, 1000)([batch.select(["text"])])
        scored = [w for out in resampling._scored(2, gain)([batch]) for w in out.column(3).to_pylist()]
    finally:
        resampling.MOST_NODES = before
    assert dict(zip(totals.column(0).to_pylist(), totals.column(1).to_pylist())) == dict(want_totals) and scored == want


def test_resampling_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    full = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert resampling.resample(docs, full).count() == 0
    (row,) = resampling.resample(full, docs).collect()
    assert row.n_features == 40 and row.rank is None
    assert resampling.drawn_documents(full.withColumn("more.x", F.lit(1)), full, percent=100).collect() == [(1, "a b " * 20, 1)]


@pytest.mark.parametrize("name", ["op12_importance_resampling", "op13_vector_codes"])
def test_equals_its_sql(name, spark, sf, duck):
    want = sorted(duck.execute(queries.ORACLES[name]).fetchall(), key=str)
    assert sorted(map(tuple, queries.QUERIES[name](spark, sf).collect()), key=str) == want


def coded(rows, parts, entries, rounds):
    """vec_id -> (code, error, label_error), and the digest, by plain Lloyd."""
    kept = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0], r[1]))
    width = -(-len(kept[0][1]) // parts)
    cut = lambda v, p: tuple((v + [0] * width * parts)[p * width : (p + 1) * width])
    vectors = [(i, [cut(v, p) for p in range(parts)], l) for i, v, l in kept]
    books = [[vec[p] for _, vec, _ in vectors[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            held = {}
            for _, vec, _ in vectors:
                held.setdefault(near(p, vec[p])[1], []).append(vec[p])
            for k, xs in held.items():
                new[p][k] = tuple(sum(c) // len(xs) for c in zip(*xs))
        books = new
    out, labels = [], Counter()
    for i, vec, l in vectors:
        best = [near(p, x) for p, x in enumerate(vec)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), l))
        labels[l] += out[-1][2]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, code, error, labels[l], digest) for i, code, error, l in out), key=str)


@pytest.mark.parametrize("length, parts, entries", [(8, 4, 5), (8, 4, 64), (10, 4, 3), (3, 4, 2)])
def test_vector_codes(spark, length, parts, entries):
    rng = random.Random(length)
    rows = [(i * 3, [rng.choice([rng.uniform(-1, 1), 0.25, -0.0]) for _ in range(length)], rng.choice([0, 1, None])) for i in range(150)]
    rows += [(1000 + i, rows[4][1], 7) for i in range(200)]  # one vector holds more than half
    rows += [(5, None, 1), (7, [math.nan] * length, 1), (8, [math.inf] + [0.0] * (length - 1), None), (9, [None] + [0.0] * (length - 1), 2), (12, rows[4][1], 2)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, code int")
    plain = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = vectorcodes.compress(df, parts=parts, entries=entries, rounds=2).collect()
    assert sorted(map(tuple, got), key=str) == coded(plain, parts, entries, 2)


def test_vectors_of_other_lengths_and_none(spark):
    schema = "vec_id long, embedding array<double>, label string"
    rows = [(1, [0.5, 0.25], "a"), (2, [0.5], "a"), (None, [0.5, 0.25], None), (3, [1e30, -1e30], "b")]
    got = {r.vec_id: (r.code, r.error) for r in vectorcodes.compress(spark.createDataFrame(rows, schema), parts=2, entries=1, rounds=0).collect()}
    large = vectorcodes.LARGEST
    assert got == {1: ("0000", 0), 2: (None, None), None: ("0000", 0), 3: ("0000", (large - 128) ** 2 + (large + 64) ** 2)}
    assert vectorcodes.compress(spark.createDataFrame([], schema)).count() == 0


def toxic_rows(rng, n):
    plain = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit", "ame") for b in ("em", "um", "or", "ana", "etis")]
    rows = []
    for i in range(n):
        said = [[rng.choice(plain) for _ in range(rng.randint(4, 12))] for _ in range(rng.randint(1, 9))]
        bad = rng.random() < 0.3
        where = rng.randrange(len(said))
        if bad:
            said[where][rng.randrange(len(said[where]))] = rng.choice(["vilewort", "VILEword", "vilewürst"]) + rng.choice(["", "!", "x"])
        rows.append((i, ". ".join(" ".join(s) for s in said) + ".", int(bad), where if bad else None))
    return rows


def test_toxicity_learns_from_documents_and_finds_sentences(spark):
    rows = toxic_rows(random.Random(2), 600)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _, _ in rows] + [(5000, None, "x"), (5001, "", "x"), (5002, "lorem ipsum. " * 20_000, "x"), (None, rows[0][1], "x"), (0, rows[0][1], "x")], "doc_id long, text string, score string")
    # labels that are held out say the opposite, so nothing can have been learned from them
    flip = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y
    labels = spark.createDataFrame([(i, flip(i, y), 0) for i, _, y, _ in rows] + [(None, 1, 0), (3, None, 0), (9999, 1, 0)], "doc_id long, toxic int, text int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + 5
    by = {r.doc_id: r for r in got}
    for i, text, y, where in rows:
        r = by[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == y == int(r.score >= 0.7) and 0 <= r.score <= 1
        assert len(r.offending) == y
        if y:
            span = text[r.offending[0].start : r.offending[0].end]
            assert "vile" in span.lower() and span.strip(" .!") == text.split(". ")[where].split("!")[0].strip(" .!")
    assert by[5000].score == by[5001].score == by[5002].score < 0.1 and not by[5002].predicted
    assert by[None].held_out is False and by[None].score == by[0].score


def test_toxicity_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.toxicity(docs, none).collect()] == [(0.0, 0)] * 2
    assert [(r.score, r.predicted) for r in toxicity.toxicity(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).collect()] == [(0.0, 0)] * 2
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


def test_held_out_toxicity(spark):
    """On the given table: labels that were not learned from."""
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op11_toxicity"](spark, sf).collect()}
    labels = [(r.toxic, got[r.doc_id].predicted) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    found, wrong = sum(t and p for t, p in labels), sum(p and not t for t, p in labels)
    assert found >= 0.6 * sum(t for t, _ in labels) and wrong <= 0.02 * len(labels)
