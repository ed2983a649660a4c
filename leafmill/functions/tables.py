"""Table functions: sentences of a table's texts, and of one text for lateral joins."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, Row, StringType, StructType

END = re.compile("[.!?…]+")


def sentences(text: str | None) -> list[str]:
    """Parts between marks that end a sentence, trimmed, without empty ones."""
    return [s for s in (part.strip() for part in END.split(text or "")) if s]


@udtf
class SplitSentences:
    """``split_sentences(TABLE(t) PARTITION BY (...) ORDER BY (...), 'column')``: the rows of a table once a
    sentence of a text column, with the table's other columns, ``n`` and ``sentence``.

    ``n`` counts on through a partition, in its order; all that is held of one is that number. Rows
    without a sentence give none."""

    def __init__(self):
        self.n = 0

    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or not column.isConstantExpression or column.value is None:
            raise Exception("split_sentences takes a table and the name of a column")
        names = [f.name for f in table.dataType.fields]
        if column.value not in names:
            raise Exception(f"no column {column.value} among {', '.join(names)}")
        schema = StructType([f for f in table.dataType.fields if f.name not in (column.value, "n", "sentence")])
        return AnalyzeResult(schema.add("n", IntegerType()).add("sentence", StringType()))

    def eval(self, row: Row, column: str) -> Iterator[tuple]:
        kept = [v for name, v in row.asDict(False).items() if name not in (column, "n", "sentence")]
        for s in sentences(row[column]):
            self.n += 1
            yield (*kept, self.n, s)


@udtf(returnType="n int, sentence string", useArrow=True)
class SentencesOf:
    """``sentences_of(text)``: the numbered sentences of one text."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from enumerate(sentences(text), 1)


def register_tables(spark: SparkSession) -> None:
    spark.udtf.register("split_sentences", SplitSentences)
    spark.udtf.register("sentences_of", SentencesOf)
