"""Reading snapshots: interval maps, range reads, partial loads, missing chunks."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Chunks loaded ahead at most when a policy names no maximum (fixed value).
PARTIAL_MAX = 16


def intervals(chunks: DataFrame) -> DataFrame:
    """Chunks with begin and end, by running sums, so lengths may differ."""
    upto = W.partitionBy("db_id").orderBy("chunk_index").rowsBetween(W.unboundedPreceding, 0)
    return chunks.withColumn("end", F.sum("size").over(upto)).withColumn("begin", F.col("end") - F.col("size"))


def range_read(chunks: DataFrame, probes: DataFrame, granularity: int, sizes: DataFrame | None = None) -> DataFrame:
    """Bytes [offset, offset + length) of each probe (probe_id, db_id, offset, length) as hex, cut at the end of the file; sizes (db_id, len) are
    summed from the chunks unless given.

    Fixed slices make the overlap an equi-join: a probe is exploded to the chunk indices it touches, within the file.
    """
    sizes = chunks.groupBy("db_id").agg(F.sum("size").alias("len")) if sizes is None else sizes
    known = probes.join(sizes, "db_id", "left").withColumn("len", F.coalesce("len", F.lit(0)))
    known = known.withColumn("lo", F.least(F.greatest("offset", F.lit(0)), "len")).withColumn("hi", F.least(F.when(F.col("length") > F.col("len") - F.col("lo"), F.col("len")).otherwise(F.col("lo") + F.col("length")), F.col("len")))
    touched = known.withColumn("chunk_index", F.explode_outer(F.when(F.col("hi") > F.col("lo"), F.sequence(F.expr(f"lo div {granularity}"), F.expr(f"(hi - 1) div {granularity}")))))
    joined = touched.join(chunks.select("db_id", "chunk_index", "begin", "data"), ["db_id", "chunk_index"], "left")
    a = F.greatest(F.col("lo") - F.col("begin"), F.lit(0)).cast("int")
    piece = F.hex(F.substring(F.col("data"), a + 1, (F.col("hi") - F.col("begin")).cast("int") - a))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("begin").isNotNull(), F.struct("chunk_index", piece.alias("h"))))), lambda x: x["h"]), "")
    return joined.groupBy("probe_id", "db_id", "lo", "hi").agg(whole.alias("bytes_hex")).select("probe_id", "db_id", (F.col("hi") - F.col("lo")).alias("n"), "bytes_hex")


def prefix_size(n: Column, least: int | None = None, most: int | None = None) -> Column:
    """Chunks that a partial load takes from the front: about the root of their number, within the policy."""
    low = F.greatest(F.lit(1), F.least(F.lit(least or 0), n))
    high = F.greatest(low, F.lit(PARTIAL_MAX if most is None else most))
    return F.least(F.greatest(F.ceil(F.sqrt(n)), low), high).cast("long")


def partial_load(chunks: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """The chunks that a partial load fetches: the prefix and the last."""
    counts = chunks.groupBy("db_id").agg(F.count(F.lit(1)).alias("n"))
    both = chunks.join(counts, "db_id")
    return both.where((F.col("chunk_index") < prefix_size(F.col("n"), least, most)) | (F.col("chunk_index") == F.col("n") - 1)).drop("n")


def fetch(wanted: DataFrame, tiers: list[DataFrame]) -> DataFrame:
    """Distinct fingerprints with the tier (0 first) that has each; null where none has."""
    held = tiers[0].select("fp", F.lit(0).alias("tier"))
    for i, tier in enumerate(tiers[1:], 1):
        held = held.unionByName(tier.select("fp", F.lit(i).alias("tier")))
    first = held.groupBy("fp").agg(F.min("tier").alias("tier"))
    return wanted.select("fp").distinct().join(first, "fp", "left")


def page_read(content: Column, offset: Column, size: int) -> Column:
    """A page of a file: size bytes from offset, filled up with zeros behind its end."""
    n = F.octet_length(content)
    got = F.when(offset < n, F.substring(content, (offset + 1).cast("int"), F.lit(size))).otherwise(F.lit(b""))
    return F.unhex(F.rpad(F.hex(got), 2 * size, "0"))


def tiered_manifests(wanted: DataFrame, local: list[DataFrame], remote: list[DataFrame], now: Column, max_age_h: int = 48) -> DataFrame:
    """Names with the tier that gives their manifest: the first local tap (name, at) that is no older than max_age_h and not from the future,
    then the first remote (name) that has it; null where none has."""
    young = (F.unix_micros(now) - F.unix_micros("at")).between(0, max_age_h * 3_600_000_000)
    held = [t.where(young).select("name", F.lit(i).alias("tier")) for i, t in enumerate(local)]
    held += [t.select("name", F.lit(i).alias("tier")) for i, t in enumerate(remote, len(local))]
    first = functools.reduce(DataFrame.unionByName, held).groupBy("name").agg(F.min("tier").alias("tier"))
    return wanted.select("name").distinct().join(first, "name", "left")


def cache_publish(chunks: DataFrame, primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """What publishing fingerprints to a cache does: a hit in the primary is accepted, one in a secondary is promoted, others are added."""
    hits = chunks.select("fp").distinct().join(primary.select("fp", F.lit(True).alias("_p")).distinct(), "fp", "left").join(secondary.select("fp", F.lit(True).alias("_s")).distinct(), "fp", "left")
    return hits.select("fp", F.when(F.col("_p"), "accept").when(F.col("_s"), "promote").otherwise("add").alias("action"))
