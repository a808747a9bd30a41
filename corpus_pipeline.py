"""The corpus pipeline: each stage works on all that the one before kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkvault.llm import line_dedup, mixing, near_dup, packing, quality
from chunkvault.llm.common import one_row_per_id, store, tidy
from chunkvault.llm.queries import tokenizer_path


def _as_documents(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, with n_chars as long as the text now is."""
    return found.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns])


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without those of ids, which grow with the documents, so they are merged and not broadcast whatever their number."""
    return docs.join(ids.select("doc_id").distinct().hint("merge"), "doc_id", "left_anti").select(*docs.columns)


@tidy
def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are scored like any; each row is judged by its own text, also where rows repeat a
    doc_id; rows without doc_id stay; an empty table stays empty; other columns of any name pass through."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@tidy
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller doc_id holds too are cut from the texts. Null texts stay null; rows that repeat a doc_id are one document and lose the same
    lines; rows without doc_id lose none; an empty table stays empty; other columns of any name pass through."""
    return _as_documents(line_dedup.dedup_lines(docs), docs)


@tidy
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by five-word shingles of similarity 0.8 or more, stays. Rows that repeat a doc_id are one document,
    that of the least text; rows without doc_id or words stay; an empty table stays empty; other columns of any name pass through."""
    docs = one_row_per_id(docs)
    found = store(near_dup.near_duplicates(docs, percent=80), "pipeline-near")
    return _without(docs, found.where("not kept"))


@tidy
def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as much of them, as the mix takes. Documents without words are not taken; a null source is one of its own; rows that repeat
    a doc_id each get its share; an empty table stays empty; other columns of any name pass through."""
    return mixing.mixed_documents(docs)


@tidy
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequences and offsets. A null or empty text is the end token alone; each row is packed, also one that repeats
    a doc_id or has none; an empty table gives no pieces; other columns are not read."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", reject_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_to_weights),
    ("packing", pack_sequences),
]

#: Trees, sketches and tokens have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
