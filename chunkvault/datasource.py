"""Snapshots as a Spark data source: spark.dataSource.register(SnapshotSource), then spark.read.format("chunkvault").load(target).

Rows are chunks in place (name, path, seq, chunk_index, begin, data) of the newest manifests of a target folder that pyarrow can open, or of one name. One
partition reads one manifest, and of the chunk commits only the fingerprints it needs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

GRANULARITY = 65536


class _Part(InputPartition):
    def __init__(self, manifest: dict):
        self.manifest = manifest


def _commits(root: str, table: str, columns: list[str], where=None):
    import pyarrow.dataset as ds
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    names = [x.path for x in files.get_file_info(fs.FileSelector(f"{base}/{table}", recursive=True, allow_not_found=True)) if x.path.endswith(".parquet")]
    return ds.dataset(names, filesystem=files, format="parquet").to_table(columns=columns, filter=where).to_pylist() if names else []


class SnapshotReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.name, self.granularity = options["path"].rstrip("/"), options.get("name"), int(options.get("granularity", GRANULARITY))

    def partitions(self) -> list[InputPartition]:
        newest: dict[str, dict] = {}
        for m in _commits(self.root, "manifests", ["name", "path", "seq", "len", "base_fp", "words", "bundled"]):
            if (self.name is None or m["name"] == self.name) and (m["name"] not in newest or newest[m["name"]]["seq"] < m["seq"]):
                newest[m["name"]] = m
        return [_Part(m) for m in newest.values()]

    def read(self, partition: _Part | None) -> Iterator[tuple]:
        import hashlib
        import struct

        import pyarrow.compute as pc

        if partition is None:  # Spark's stand-in where there are no partitions
            return
        m = partition.manifest
        words = [w & ((1 << 64) - 1) for w in m["words"]]
        chunks = lambda fps: {c["fp"]: c["data"] for c in _commits(self.root, "chunks", ["fp", "data"], pc.field("fp").isin(sorted(fps)))}
        if m["base_fp"]:
            base = chunks({m["base_fp"]})[m["base_fp"]]
            own = struct.unpack(f"<{len(base) // 8}Q", base)
            words = [w ^ (own[i] if i < len(own) else 0) for i, w in enumerate(words)]
        fps = [f"{a:016x}{b:016x}" for a, b in zip(words[::2], words[1::2], strict=True)]
        held = {b["fp"]: b["data"] for b in m["bundled"]}
        zeros = bytes(self.granularity)
        held[hashlib.md5(zeros).hexdigest()] = zeros
        held |= chunks(set(fps) - set(held))
        for i, fp in enumerate(fps):
            if fp not in held:
                raise FileNotFoundError(f"chunk {fp} of {m['name']}")
            yield m["name"], m["path"], m["seq"], i, i * self.granularity, held[fp]


class SnapshotSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunkvault"

    def schema(self) -> str:
        return "name string, path string, seq bigint, chunk_index bigint, begin bigint, data binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SnapshotReader(self.options)
