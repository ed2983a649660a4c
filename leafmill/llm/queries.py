"""The registered queries of this subpackage: one ``opN_<name>`` an operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import licenses, mixing, quality, resampling, vectorcodes


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark, sf_dir):
    from leafmill.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op2_near_duplicates(spark, sf_dir):
    from leafmill.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), words_each=5, threshold=75)


def op3_html_text(spark, sf_dir):
    from leafmill.llm.htmltext import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op4_license_scan(spark, sf_dir):
    from leafmill.llm.licenses import document_licenses

    return document_licenses(_table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark, sf_dir):
    from leafmill.llm.ann import nearest_neighbours

    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_source_mix(spark, sf_dir):
    from leafmill.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark, sf_dir):
    from leafmill.llm.quality import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"))


def op8_token_orc(spark, sf_dir):
    from leafmill.llm.tokenorc import token_orc_round_trip

    return token_orc_round_trip(_table(spark, sf_dir, "documents"), _path("word_bpe_49k.json"), end_id=1)


def op9_token_counts(spark, sf_dir):
    from leafmill.llm.tokencount import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), _path("piece_bpe_32k.model"), budget=4096)


def op10_repeated_substrings(spark, sf_dir):
    from leafmill.llm.substring import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), length=50)


def op12_importance_resampling(spark, sf_dir):
    from leafmill.llm.resampling import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), most=1, buckets=10_000, percent=10, least_words=20, seed="2024")


def op13_vector_codes(spark, sf_dir):
    from leafmill.llm.vectorcodes import compress

    return compress(_table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def op11_toxicity(spark, sf_dir):
    from leafmill.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_html_text": op3_html_text,
    "op4_license_scan": op4_license_scan,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_source_mix": op6_source_mix,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_orc": op8_token_orc,
    "op9_token_counts": op9_token_counts,
    "op10_repeated_substrings": op10_repeated_substrings,
    "op11_toxicity": op11_toxicity,
    "op13_vector_codes": op13_vector_codes,
    "op12_importance_resampling": op12_importance_resampling,
}

ORACLES: dict[str, str] = {"op4_license_scan": licenses.oracle(), "op6_source_mix": mixing.oracle(), "op7_quality_rules": quality.oracle(), "op12_importance_resampling": resampling.oracle(), "op13_vector_codes": vectorcodes.oracle()}
