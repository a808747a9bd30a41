"""Change tracking: from a log of writes to the chunks a snapshot must scan again, and what it may keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dirty_chunks(log: DataFrame, granularity: int) -> DataFrame:
    """A row for each chunk index that a write (offset, count) touches; an empty write touches none."""
    touched = F.sequence(F.expr(f"offset div {granularity}"), F.expr(f"(offset + count - 1) div {granularity}"))
    return log.withColumn("chunk_index", F.explode(F.when(F.col("count") > 0, touched)))


def truncated(old: Column, new: Column, granularity: int) -> Column:
    """Chunk indices that a change of length from old to new makes dirty."""
    low, high = F.least(old, new), F.greatest(old, new)
    return F.when(high > low, F.sequence(F.floor(low / granularity), F.floor((high - 1) / granularity))).otherwise(F.array().cast("array<bigint>"))


def judge(dirty: Column, any_dirty: Column, prev: Column, cur: Column, manifest: Column) -> Column:
    """up_to_date, initial (incremental) or desync, as the state before a snapshot allows. Empty versions match nothing."""
    p, c = F.nullif(prev, F.lit("")), F.nullif(cur, F.lit(""))
    trusted = p.isNotNull() & c.isNotNull() & (p != c) & any_dirty & ((manifest == p) | (manifest == c))
    return F.when(dirty, F.when(F.coalesce(trusted, F.lit(False)), "initial").otherwise("desync")).otherwise(F.when(F.coalesce(c == manifest, F.lit(False)), "up_to_date").otherwise("desync"))


def backfill_start(base_chunks: Column, chunks: Column, beyond: Column) -> Column:
    """The first chunk that is always scanned: where the base list ends, one less if the file grew or a write went past it."""
    step = F.when((base_chunks < chunks) | beyond, 1).otherwise(0)
    return F.when(base_chunks.isNull(), 0).otherwise(F.greatest(F.least(base_chunks, chunks) - step, F.lit(0))).cast("long")


def manifest_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows (key, chunk_index, change): added, removed, changed or same, by one full outer equi-join."""
    on = [*key, "chunk_index"]
    both = old.select(*on, F.col("fp").alias("old_fp")).join(new.select(*on, F.col("fp").alias("new_fp")), on, "full_outer")
    change = F.when(F.col("old_fp").isNull(), "added").when(F.col("new_fp").isNull(), "removed").when(F.col("old_fp") == F.col("new_fp"), "same").otherwise("changed")
    return both.select(*on, change.alias("change"))


def incremental(old: DataFrame, scanned: DataFrame, sizes: DataFrame, dirty: DataFrame) -> DataFrame:
    """Chunk rows after a snapshot that scans only dirty chunks and those from backfill on, and carries the rest forward.

    sizes: (db_id, n, backfill); dirty and scanned: by (db_id, chunk_index).
    """
    key = ["db_id", "chunk_index"]
    carried = old.join(sizes, "db_id").where("chunk_index < backfill and chunk_index < n").join(dirty.select(*key), key, "left_anti").select(*key, "fp")
    again = scanned.join(sizes, "db_id").join(dirty.select(*key, F.lit(True).alias("d")).distinct(), key, "left")
    again = again.where("(chunk_index >= backfill or d) and chunk_index < n").select(*key, "fp")
    return carried.unionByName(again)


def aligned_writes(log: DataFrame, granularity: int) -> DataFrame:
    """Writes of exactly one whole chunk, but for the first, whose bytes are staged at once as they are at hand."""
    return log.where((F.col("count") == granularity) & (F.col("offset") % granularity == 0) & (F.col("offset") > 0))


def first_writes(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first write of each transaction, which gives the file a new version id."""
    return log.groupBy(*key).agg(F.min(order).alias(order))


def sizes_after(log: DataFrame, key: str) -> DataFrame:
    """Sizes of files after all writes of a log, from nothing: the furthest byte written."""
    return log.where(F.col("count") > 0).groupBy(key).agg(F.max(F.col("offset") + F.col("count")).alias("size"))


def rescan_from(listed: DataFrame, scrubbed: DataFrame, key: str) -> DataFrame:
    """Per key: mismatch, whether a scrubbed chunk (chunk_index, fp) isn't as listed, and backfill, where the next scan begins: 0 then, else behind the list."""
    checked = listed.join(scrubbed.select(key, "chunk_index", F.col("fp").alias("_found")), [key, "chunk_index"], "left")
    bad = F.coalesce(F.bool_or((F.col("_found") != F.col("fp"))), F.lit(False))
    return checked.groupBy(key).agg(bad.alias("mismatch"), F.when(bad, 0).otherwise(F.count(F.lit(1))).alias("backfill"))
