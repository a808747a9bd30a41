"""Structured Streaming jobs. Each runs until its input is used up and returns the table that it wrote.

Sinks write to fresh folders in the shared storage, with checkpoints beside them; nothing is held in the driver.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from chunkvault.operators.tracking import dirty_chunks
from chunkvault.storage import fresh_path, setting

#: Files of a micro-batch, as a reader of a spool takes its entries.
PER_TRIGGER = 10


def read_events(spark: SparkSession, path: str, per_trigger: int = PER_TRIGGER) -> DataFrame:
    """Events of a file, or of a folder of files in the order in which they were written."""
    schema = spark.read.option("recursiveFileLookup", "true").parquet(path).schema
    reader, place = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true"), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():  # a stream reads folders
        reader, path = reader.option("pathGlobFilter", place.getName()), place.getParent().toString()
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def run_appending(df: DataFrame, tag: str) -> DataFrame:
    """Appends to parquet until the input ends."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, tag)
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def run_completing(df: DataFrame, tag: str, mode: str = "complete") -> DataFrame:
    """Writes each batch's whole result over the one before."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, tag)
    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(path)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def stream_dirty(spark: SparkSession, path: str, granularity: int) -> DataFrame:
    """Dirty chunks of each transaction, once: the log is exploded to chunks and repeats are dropped by state."""
    e = F.col("event_id")
    log = read_events(spark, path).select(F.col("user_id").alias("db_id"), F.expr("event_id div 8").alias("txn"), ((e * 7919) % (16 * granularity)).alias("offset"), (1 + (e * 104729) % (2 * granularity)).alias("count"))
    return run_appending(dirty_chunks(log, granularity).select("db_id", "txn", "chunk_index").dropDuplicates(), "stream-dirty")


def stream_distinct(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The first of each key: what insert-if-absent lets through. State grows with the number of keys, not of events."""
    return run_appending(read_events(spark, path).select(*columns).dropDuplicates(columns), "stream-distinct")


class Throttle(StatefulProcessor):
    """Keeps the time of the last kept event of each key; drops events within the gap after it. Late events are compared too."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(["at", "event_id"])
        last, kept = (self.last.get()[0] if self.last.exists() else None), []
        for event_id, at in zip(events["event_id"].tolist(), events["at"].tolist(), strict=True):
            if last is None or at - last >= self.gap:
                kept.append(event_id)
                last = at
        self.last.update((last,))
        yield pd.DataFrame({"event_id": pd.Series(kept, dtype="int64")})

    def close(self) -> None:
        pass


def stream_throttle(spark: SparkSession, path: str, gap: int) -> DataFrame:
    """Events that a throttle of one each gap and key performs, with state in RocksDB."""
    with setting(spark, "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        events = read_events(spark, path).select("user_id", "event_type", "event_id", F.unix_micros("ts").alias("at"))
        kept = events.groupBy("user_id", "event_type").transformWithStateInPandas(Throttle(gap), StructType([StructField("event_id", LongType())]), "append", "none")
        return run_appending(kept, "stream-throttle")


def in_files(spark: SparkSession, path: str, many: int) -> str:
    """A folder with the events in as many files, in order of time, each written after the one before."""
    events, folder = spark.read.parquet(path), fresh_path(spark, "events")
    stamped = events.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    bounds = [None, *stamped.approxQuantile("_us", [i / many for i in range(1, many)], 0.001), None]
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
        part = stamped if lo is None else stamped.where(F.col("_us") >= lo)
        part = part if hi is None else part.where(F.col("_us") < hi)
        part.drop("_us").coalesce(1).write.mode("append").parquet(f"{folder}/{i:04d}")
    return folder


def stream_late(spark: SparkSession, path: str) -> DataFrame:
    """Daily counts in append mode with a watermark of one day; events from before 20 January whose id is 2 in 3 come last, too late."""
    events, folder = spark.read.parquet(path), fresh_path(spark, "events-late")
    late = F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")
    odd = F.col("event_id") % 2 == 1  # a batch drops what the watermark of the batch before has passed, so there are two of them in between
    parts = (events.where(late & (F.col("event_id") % 3 < 2)), events.where(~late & ~odd), events.where(~late & odd), events.where(late & (F.col("event_id") % 3 == 2)))
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{folder}/{i}")
    arriving = read_events(spark, folder, 1).withWatermark("ts", "1 day")
    counts = arriving.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return run_appending(counts.select(F.col("window.start").alias("start"), "event_type", "n"), "stream-late")


def stream_lag(spark: SparkSession, path: str, upload: str) -> DataFrame:
    """How far each user's uploads are behind its changes, in microseconds, 0 for those that are not."""
    us, uploaded = F.unix_micros("ts"), F.col("event_type") == upload
    ends = read_events(spark, path).groupBy("user_id").agg(F.max(F.when(~uploaded, us)).alias("changed"), F.max(F.when(uploaded, us)).alias("uploaded"))
    behind = F.coalesce("changed", F.lit(0)) - F.coalesce("uploaded", F.lit(0))
    return run_completing(ends.select("user_id", F.greatest(behind, F.lit(0)).alias("lag_us")), "stream-lag")


def stream_windows(spark: SparkSession, path: str, width: str, slide: str | None = None) -> DataFrame:
    """Counts by event type in tumbling or sliding windows of event time."""
    events = read_events(spark, path).withWatermark("ts", "40 days")
    counts = events.groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return run_completing(counts.select(F.col("window.start").alias("start"), "event_type", "n"), "stream-windows")


def stream_sessions(spark: SparkSession, path: str, gap: str) -> DataFrame:
    events = read_events(spark, path).withWatermark("ts", "40 days")
    counts = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return run_completing(counts.select("user_id", F.col("session_window.start").alias("start"), "n"), "stream-sessions")


def stream_latest(spark: SparkSession, path: str) -> DataFrame:
    """The last event of each user: versions in between are squashed."""
    last = read_events(spark, path).groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return run_completing(last, "stream-latest")
