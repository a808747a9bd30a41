"""A store of snapshots: chunks by fingerprint, lists of chunks, and manifests, each a table under one path.

Writing order is the commit protocol: chunks before lists before manifests. Readers start from manifests, so what an interrupted
sync has left is never seen, and collection removes it later. Collection writes a new generation of the chunk table and then switches a
pointer to it, so that no moment has fewer chunks than manifests need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from chunkvault.errors import ReadOnlyError
from chunkvault.filesystem import Folder, Lock
from chunkvault.operators import chunks as C
from chunkvault.operators import manifests as M
from chunkvault.operators import snapshots as S
from chunkvault.storage import store

CHUNKS = "fp string, size long, data binary"
LISTS = "db_id long, seq long, chunk_index long, begin long, size long, fp string"
MANIFESTS = "db_id long, host string, path string, seq long, len long, n_chunks long, header_fp string, contents_fp string"


class Vault:
    def __init__(self, spark: SparkSession, path: str, granularity: int = C.GRANULARITY):
        self.spark, self.path, self.granularity = spark, path.rstrip("/"), granularity

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _chunks_at(self) -> str:
        """The folder of the current generation of chunks."""
        return f"chunks-{(Folder(self.spark, self.path) / 'generation').read_text() or 0}"

    def chunks(self) -> DataFrame:
        return self._table(self._chunks_at(), CHUNKS)

    def manifests(self) -> DataFrame:
        return self._table("manifests", MANIFESTS)

    def latest(self) -> DataFrame:
        return M.latest(self.manifests(), ["db_id"], ["seq"])

    def sync(self, files: DataFrame) -> DataFrame:
        """Snapshots files (db_id, host, path, content); those whose contents are as in their latest manifest are left alone. Returns the new manifests."""
        with Lock(Folder(self.spark, self.path), lease_s=3600):
            return self._sync(files)

    def _sync(self, files: DataFrame) -> DataFrame:
        built = M.build_manifests(files, self.granularity).join(files.select("db_id", "host", "path"), "db_id")
        known = self.latest().select("db_id", F.col("contents_fp").alias("_old"), F.col("len").alias("_len"), F.col("seq").alias("_seq"))
        changed = built.join(known, "db_id", "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("contents_fp")) | (F.col("_len") != F.col("len")))
        changed = store(changed.withColumn("seq", F.coalesce(F.col("_seq") + 1, F.lit(0))).select(*self.manifests().columns), "vault-changed")
        scanned = C.chunk_scan(files.join(changed.select("db_id"), "db_id", "left_semi"), self.granularity, with_data=True)
        fresh = C.chunk_store(scanned, self.granularity).join(self.chunks().select("fp"), "fp", "left_anti")
        fresh.write.mode("append").parquet(f"{self.path}/{self._chunks_at()}")
        scanned.join(changed.select("db_id", "seq"), "db_id").select("db_id", "seq", "chunk_index", "begin", "size", "fp").write.mode("append").parquet(f"{self.path}/lists")
        changed.write.mode("append").parquet(f"{self.path}/manifests")
        return changed

    def snapshot(self, manifests: DataFrame | None = None) -> DataFrame:
        """Chunk rows with data of the given manifests (the latest ones); the well-known chunk is made, not read."""
        chosen = (self.latest() if manifests is None else manifests).select("db_id", "seq")
        lists = self._table("lists", LISTS).join(chosen, ["db_id", "seq"])
        zeros = F.when(F.col("fp") == C.zero_fingerprint(self.granularity), F.unhex(F.lit("00" * self.granularity)))
        return lists.join(self.chunks().select("fp", "data"), "fp", "left").withColumn("data", F.coalesce("data", zeros))

    def missing(self) -> DataFrame:
        """Chunks that a manifest needs and the store lacks."""
        return self.snapshot(self.manifests()).where("data is null").select("fp").distinct()

    def restore(self, manifests: DataFrame | None = None) -> DataFrame:
        """Rows (db_id, path, content, valid): whole files, and whether length and fingerprint are as the manifest says. For files that don't fit a
        row see restore_chunks."""
        chosen = self.latest() if manifests is None else manifests
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", F.hex("data").alias("h")))), lambda x: x["h"]), "")
        made = self.snapshot(chosen).groupBy("db_id").agg(F.unhex(whole).alias("content"), F.sum("size").alias("got"), C.list_fingerprint(F.col("chunk_index"), F.col("fp")).alias("got_fp"), F.every(F.md5("data") == F.col("fp")).alias("sound"))
        out = chosen.join(made, "db_id", "left")
        valid = ((F.col("len") == 0) & F.col("got").isNull()) | F.coalesce(F.col("sound") & (F.col("got") == F.col("len")) & (F.col("got_fp") == F.col("contents_fp")), F.lit(False))
        return out.select("db_id", "path", F.coalesce("content", F.lit(b"")).alias("content"), valid.alias("valid"))

    def restore_chunks(self, manifests: DataFrame | None = None) -> DataFrame:
        """Rows (db_id, path, begin, data, valid): files chunk by chunk, of any size, each chunk held against its fingerprint."""
        chosen = self.latest() if manifests is None else manifests
        sound = F.coalesce((F.md5("data") == F.col("fp")) & (F.octet_length("data") == F.col("size")), F.lit(False))
        return self.snapshot(chosen).join(chosen.select("db_id", "path"), "db_id").select("db_id", "path", "begin", "data", sound.alias("valid"))

    def read(self, probes: DataFrame) -> DataFrame:
        """Byte ranges of the latest snapshots; see snapshots.range_read."""
        return S.range_read(self.snapshot(), probes, self.granularity)

    def write(self, *_: object) -> None:
        raise ReadOnlyError("a snapshot is read-only", path=self.path)

    def garbage(self) -> DataFrame:
        """Fingerprints of stored chunks that no manifest needs."""
        live = self._table("lists", LISTS).join(self.manifests().select("db_id", "seq"), ["db_id", "seq"], "left_semi")
        return self.chunks().select("fp").join(live.select("fp"), "fp", "left_anti")

    def collect_garbage(self) -> int:
        """Writes a generation of the chunk table without garbage and switches to it; returns how many chunks went. Other writers wait meanwhile."""
        root = Folder(self.spark, self.path)
        with Lock(root, lease_s=3600):
            gone = store(self.garbage(), "vault-garbage")
            n = gone.count()
            if n:
                old = self._chunks_at()
                new = int(old.rpartition("-")[2]) + 1
                (root / f"chunks-{new}").delete()  # of a collection that was cut off
                self.chunks().join(gone, "fp", "left_anti").write.parquet(f"{self.path}/chunks-{new}")
                (root / "generation").write_bytes(str(new).encode())
                (root / old).delete()
        return n
