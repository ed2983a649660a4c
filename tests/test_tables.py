"""Table functions."""

import pytest

from leafmill.functions.tables import register_tables


def test_sentences_of_a_partitioned_table(spark):
    register_tables(spark)
    df = spark.createDataFrame([(1, 1, "One. Two!", "a"), (1, 2, None, "b"), (1, 3, "Three", "c"), (2, 1, " ?! . ", "d"), (2, 2, "Four… five.", "e"), (None, 1, "x", "f")], "k int, turn int, said string, n string")
    got = spark.sql("SELECT * FROM split_sentences(TABLE(SELECT * FROM {t}) PARTITION BY (k) ORDER BY (turn), 'said')", t=df)
    assert got.columns == ["k", "turn", "n", "sentence"]  # the table's own column n gives way
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 1, 1, "One"), (1, 1, 2, "Two"), (1, 3, 3, "Three"), (2, 2, 1, "Four"), (2, 2, 2, "five"), (None, 1, 1, "x")], key=str)
    with pytest.raises(Exception, match="no column text"):
        spark.sql("SELECT * FROM split_sentences(TABLE(SELECT * FROM {t}) PARTITION BY (k), 'text')", t=df).collect()
    lateral = spark.sql("SELECT turn, x.n, sentence FROM {t} t, LATERAL sentences_of(said) x WHERE k = 1", t=df)
    assert sorted(map(tuple, lateral.collect())) == [(1, 1, "One"), (1, 2, "Two"), (3, 1, "Three")]
