"""The pipeline against its stages restated plainly."""

import random
from collections import Counter

import corpus_pipeline
from tests.llm import brute


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, sf)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert good.columns == docs.columns
    kept = {r.doc_id: r.text for r in good.collect()}
    assert not [d for d in kept if brute.quality(texts[d])[5]]

    single = stages["near_duplicates"](spark, good, sf)
    parts, _ = brute.components(kept)
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == sorted(set(parts.values()))

    left = stages["repeated_passages"](spark, single, sf)
    cut = brute.cuts({d: kept[d] for d in set(parts.values())})
    want = {d: c[4].decode(errors="ignore") for d, c in cut.items()}
    want = {d: t for d, t in want.items() if brute.WORD.search(t)}
    assert left.columns == docs.columns and {r.doc_id: r.text for r in left.collect()} == want
    assert all(r.n_chars == len(r.text) for r in left.collect())

    mixed = stages["source_mix"](spark, left, sf)
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) <= set(want) and max(times.values()) <= 3

    packed = stages["packed_sequences"](spark, mixed, sf).collect()
    first = Counter(r.doc_id for r in packed if r.piece == 0)
    assert first == times
    assert corpus_pipeline.run(spark, sf).count() == len(packed)


def test_odd_rows_go_through(spark, tmp_path):
    """Null, empty and very long texts, repeated rows and ids, ties, columns with the names of results."""
    from tests.llm.test_operators import DOC, odd_rows, prose

    rng = random.Random(3)
    long = prose(rng, 30_000)
    rows = [*odd_rows(), *[(900 + i, prose(rng, 80), "s1", 7, "x", "y", 1, "z", 3, "q") for i in range(5)], (None, prose(rng, 70), None, 7, "x", "y", 1, "z", 3, "q"), (990, long, "s2", 7, "x", "y", 1, "z", 3, "q"), (991, long, "s2", 7, "x", "y", 1, "z", 3, "q")]
    place = str(tmp_path / "sf")
    spark.createDataFrame(rows, DOC).write.parquet(f"{place}/documents.parquet")
    docs = spark.read.parquet(f"{place}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, place)
        assert out.columns == docs.columns and out.schema["rest.x"].dataType == docs.schema["rest.x"].dataType, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        ids = [r.doc_id for r in docs.collect()]
        assert None in ids and 990 in ids and (name == "quality_rules" or 991 not in ids)
    assert corpus_pipeline.run(spark, place).count() > 0
    spark.createDataFrame([], DOC).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_working_tables_go(spark, sf):
    import os

    from leafmill.session import shared_folder

    def held():
        return {x for x in os.listdir(shared_folder(spark).removeprefix("file://")) if x.startswith("leafmill-")}

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = held()
        stage(spark, docs, sf).count()
        assert len(held() - before) <= 1
