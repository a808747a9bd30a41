"""The queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkvault.llm import additive, line_dedup, mixing, near_dup, oracles, packing, pii, quality, secrets, suffix_dedup, threshold
from chunkvault.llm.common import tidy


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary that the packing contract names, as installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


@tidy
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).taken()


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_digest(table(spark, sf_dir, "documents"))


def op4_additive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return additive.search(vectors, threshold.queries_of(vectors, 50))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return threshold.top_k(vectors, threshold.queries_of(vectors, 100))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.substring_digest(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = [op1_secret_scan, op2_mix_sources, op3_personal_data, op4_additive_search, op5_line_dedup, op6_near_duplicates, op7_threshold_top_k, op8_best_fit_packing, op9_quality, op10_suffix_dedup]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
