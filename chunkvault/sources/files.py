"""Sources of files, and the configuration of where snapshots go."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkvault.operators.chunks import GRANULARITY, fingerprint, header_fingerprint


def read_files(spark: SparkSession, path: str, host: str = "") -> DataFrame:
    """Files under a path of any Hadoop file system as rows (host, path, db_id, content, modified). A row holds a file, so files are bounded by 2 GB; see
    read_chunks for larger ones."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.lit(host).alias("host"), "path", F.xxhash64(F.lit(host), "path").alias("db_id"), "content", F.col("modificationTime").alias("modified"))


def versioned(files: DataFrame) -> DataFrame:
    """Files as a spool takes them: with a version (the header's fingerprint, empty for files too short to have one) and a change time in ns."""
    version = F.coalesce(header_fingerprint(F.col("content")), F.lit(""))
    return files.select("db_id", "host", "path", version.alias("version"), (F.unix_micros("modified") * 1000).alias("ctime"), "content")


def read_chunks(spark: SparkSession, path: str, host: str = "", granularity: int = GRANULARITY, chunks_a_task: int = 256) -> DataFrame:
    """Chunks (db_id, path, chunk_index, begin, size, fp, data) of files of any size: listed by Spark without their contents, cut into ranges, and each range
    read where it is needed. pyarrow must be able to open the paths."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    step = granularity * chunks_a_task
    ranges = listed.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("at"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name, length, at in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "at")), strict=True):
                files, place = fs.FileSystem.from_uri(quote(name, safe="/:@")) if ":" in name else (fs.LocalFileSystem(), name)
                with files.open_input_file(place) as f:
                    for begin in range(at, min(at + step, length), granularity):
                        data = f.read_at(min(granularity, length - begin), begin)
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([begin // granularity]), pa.array([begin]), pa.array([len(data)]), pa.array([data], pa.binary())], ["path", "chunk_index", "begin", "size", "data"])

    found = ranges.repartition("path", "at").mapInArrow(rows, "path string, chunk_index long, begin long, size long, data binary")
    return found.select(F.xxhash64(F.lit(host), "path").alias("db_id"), "path", "chunk_index", "begin", "size", fingerprint(F.col("data")).alias("fp"), "data")


@dataclass
class Target:
    """A place that snapshots are copied to (remote, by URI) or read back through (local caches)."""

    kind: str
    uri: str
    create: bool = False

    def __repr__(self) -> str:  # URIs may hold credentials before an @
        head, _, tail = self.uri.rpartition("@")
        return f"Target({self.kind}, {'***@' if head else ''}{tail})"


@dataclass
class Options:
    """Configuration: JSON text, @file, or the CHUNKVAULT_CONFIG environment variable. All fields have defaults."""

    make_default: bool = False
    spooling_dir: str | None = None
    granularity: int = 65536
    targets: list[Target] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str | None = None) -> Options:
        text = os.environ.get("CHUNKVAULT_CONFIG", "{}") if text is None else text
        if text.startswith("@"):
            with open(text[1:]) as f:
                text = f.read()
        raw = json.loads(text)
        targets = []
        for target in raw.get("replication_targets", []):
            (kind, spec), = target.items()
            if kind not in ("s3", "local", "read_only"):
                raise ValueError(f"unknown target kind: {kind}")
            uri = spec.get("directory") or f"s3a://{spec['chunk_bucket']}"
            targets.append(Target(kind, uri, bool(spec.get("create_buckets_on_demand", False))))
        return cls(bool(raw.get("make_default", False)), raw.get("replication_spooling_dir"), int(raw.get("granularity", 65536)), targets)
