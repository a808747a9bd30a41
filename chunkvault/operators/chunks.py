"""Chunks: fixed-size slices of files, named by fingerprint.

A file is a row (db_id, .., content). Slicing is an array expression and one explode, so a scan has no shuffle; only the chunk store,
which is unique by fingerprint, needs one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a chunk in production (fixed value of the format).
GRANULARITY = 65536
HEADER_BYTES = 100


def fingerprint(data: Column) -> Column:
    """The 128-bit name of some bytes, as 32 hex digits."""
    return F.md5(data)


def fingerprint_words(fp: Column) -> tuple[Column, Column]:
    """Both 64-bit halves of a fingerprint, as signed longs."""
    return tuple(F.conv(F.substring(fp, at, 16), 16, -10).cast("long") for at in (1, 17))


def chunk_count(size: Column, granularity: int = GRANULARITY) -> Column:
    """An empty file has no chunk."""
    return F.ceil(size / F.lit(granularity)).cast("long")


def slices(content: Column, granularity: int = GRANULARITY) -> Column:
    """The slices of a file in order; the last may be short."""
    last = (chunk_count(F.octet_length(content), granularity) - 1).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(content, i * granularity + 1, F.lit(granularity)))
    return F.when(F.octet_length(content) > 0, cut).otherwise(F.array().cast("array<binary>"))


def chunk_scan(files: DataFrame, granularity: int = GRANULARITY, with_data: bool = False) -> DataFrame:
    """Rows (db_id, chunk_index, begin, size, fp), and data if asked."""
    cut = files.select("db_id", F.posexplode(slices(F.col("content"), granularity)).alias("i", "data"))
    out = [F.col("db_id"), F.col("i").cast("long").alias("chunk_index"), (F.col("i").cast("long") * granularity).alias("begin"), F.octet_length("data").cast("long").alias("size"), fingerprint(F.col("data")).alias("fp")]
    return cut.select(*out, *(["data"] if with_data else []))


def header_fingerprint(content: Column) -> Column:
    """Fingerprint of the first hundred bytes; null for shorter files."""
    return F.when(F.octet_length(content) >= HEADER_BYTES, fingerprint(F.substring(content, 1, HEADER_BYTES)))


def zero_fingerprint(granularity: int = GRANULARITY) -> Column:
    """The well-known chunk, of zeros only: never stored. A literal, so it folds."""
    return fingerprint(F.unhex(F.lit("00" * granularity)))


def chunk_store(chunks: DataFrame, granularity: int = GRANULARITY) -> DataFrame:
    """Unique chunks (fp, size, data), without the well-known one."""
    return chunks.where(F.col("fp") != zero_fingerprint(granularity)).groupBy("fp").agg(F.first("size").alias("size"), F.first("data").alias("data"))


def new_chunks(scanned: DataFrame, existing: DataFrame) -> DataFrame:
    """Distinct fingerprints of scanned that existing lacks: what staging writes."""
    return scanned.select("fp", "size").distinct().join(existing.select("fp"), "fp", "left_anti")


def list_fingerprint(index: Column, fp: Column) -> Column:
    """Aggregate: the fingerprint of a list of fingerprints in order."""
    return F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(index.alias("i"), fp.alias("f")))), lambda x: x["f"]), "").cast("binary"))
