"""The local buffer between a producer and the copier: many files' snapshots as tables whose folder names their state.

staging holds the newest manifests and the chunks that no target is known to have, each commit a folder of its own; ready is a
consistent set, manifests and all their staged chunks, that is published by one rename; consuming is a ready set that a copier has claimed by another
rename; tap is what was uploaded last. Chunks are always written before manifests, so what an interrupted producer leaves is never
referred to. A set that was claimed and not finished is found in consuming again and handled first.
"""

from __future__ import annotations

import functools
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkvault.filesystem import Folder
from chunkvault.operators import chunks as C
from chunkvault.operators import maintenance as U
from chunkvault.operators import manifests as M
from chunkvault.storage import store, writing

CHUNKS = "fp string, size long, data binary"
META = f"{M.MANIFEST}, identifier string"


def read_commits(spark: SparkSession, folder: Folder, schema: str, names: list[str] | None = None) -> DataFrame:
    """The rows of a folder's commits."""
    names = folder.names() if names is None else names
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder.path}/{n}" for n in names])


def commit(df: DataFrame, folder: Folder) -> str | None:
    """Writes df beside the folder and moves it in as one commit, unless it has no rows; commits sort by time."""
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    scratch = Folder(folder.spark, f"{folder.path}.scratch/{name}")
    with writing(folder.spark):
        df.write.option("compression", "zstd").parquet(scratch.path)
    if folder.spark.read.schema(df.schema).parquet(scratch.path).isEmpty():
        scratch.delete()
        return None
    scratch.rename(folder / name)
    return name


class Spool:
    """A spool folder. boot tells instances apart: a spool of another boot is not trusted, and snapshots start from scratch."""

    def __init__(self, spark: SparkSession, path: str, granularity: int = C.GRANULARITY, boot: str = ""):
        self.spark, self.granularity, self.root = spark, granularity, Folder(spark, f"{path.rstrip('/')}{'/' + boot if boot else ''}")
        self.chunks, self.meta = self.root / "staging/chunks", self.root / "staging/meta"
        self.ready, self.consuming, self.tap, self.metadata = self.root / "ready", self.root / "consuming", self.root / "tap", self.root / ".metadata"

    # Targets, as JSON beside the data, so that a copier of another process knows where it goes.

    def write_targets(self, targets: list[dict]) -> None:
        self.root.make()
        self.metadata.write_bytes(json.dumps({"replication_targets": targets}).encode())

    def targets(self) -> list[dict]:
        text = self.metadata.read_text()
        return json.loads(text)["replication_targets"] if text else []

    # What each state holds.

    def staged_chunks(self) -> DataFrame:
        return read_commits(self.spark, self.chunks, CHUNKS)

    def staged_manifests(self) -> DataFrame:
        """The newest staged manifest of each file."""
        return M.once(read_commits(self.spark, self.meta, META), ["db_id"], ["seq"])

    def tapped(self) -> DataFrame:
        """The last uploaded manifest of each file."""
        return M.once(read_commits(self.spark, self.tap, META), ["db_id"], ["seq"])

    def current(self) -> DataFrame:
        """What a producer goes on from: the newest manifests in any state, without lists and bytes."""
        held = [read_commits(self.spark, f, META).drop("words", "bundled") for f in [self.meta, self.tap, *(f / "meta" for f in self.sets())]]
        return M.latest(functools.reduce(DataFrame.unionByName, held), ["db_id"], ["seq"])

    def sets(self) -> list[Folder]:
        """Ready and consuming sets."""
        return [f / n for f in (self.consuming, self.ready) for n in f.names()]

    # The producer.

    def stage(self, files: DataFrame, base: str = "reuse") -> DataFrame:
        """Snapshots files (db_id, host, path, version, ctime, content) whose version or contents are not those of their newest manifest.
        New chunks are staged, then manifests; base says what is done about base chunks (see manifests.base_action): reuse keeps that of the
        manifest before, refresh writes a new one from the list, none has none. Returns the new manifests, without a base."""
        known = self.current().select("db_id", F.col("contents_fp").alias("_old"), F.col("version").alias("_version"), F.col("seq").alias("_seq"), F.col("base_fp").alias("_base"))
        built = M.manifest_rows(files.withColumn("seq", F.lit(0).cast("long")), self.granularity)
        new = self._fresh()
        if new:
            changed = built.withColumn("_base", F.lit(None).cast("string"))
        else:
            # Of files that have a manifest only facts meet it; files that have changed, or are unknown, are then told by the ids of the others.
            facts = built.select("db_id", "version", "contents_fp").join(known, "db_id")
            # An empty version matches nothing, not even itself.
            same = (F.col("version") == F.col("_version")) & (F.col("version") != "") & (F.col("contents_fp") == F.col("_old"))
            seen = store(facts.select("db_id", "_seq", "_base", F.coalesce(same, F.lit(False)).alias("_same")), "spool-seen")
            files = M.without(files, "db_id", seen.where("_same").select("db_id"))
            later = seen.where("not _same").select("db_id", "_seq", "_base")
            built = M.manifest_rows(files.withColumn("seq", F.lit(0).cast("long")), self.granularity)
            changed = built.withColumn("_base", F.lit(None).cast("string"))
            if not later.isEmpty():
                changed = built.join(later, "db_id", "left").withColumn("seq", F.coalesce(F.col("_seq") + 1, F.lit(0).cast("long"))).select(*built.columns, "_base")
        changed = store(changed, "spool-changed")
        scanned = C.chunk_scan(files, self.granularity, with_data=True)
        needed = scanned.where(~F.col("begin").isin(*M.BUNDLED_OFFSETS) & (F.col("fp") != C.zero_fingerprint(self.granularity)))
        fresh = M.once(needed.select("fp", "size", "data"), ["fp"])
        manifests = changed.drop("_base")
        if base == "refresh":
            lists = changed.select(F.md5(M.bytes_of_words(F.col("words"))).alias("fp"), F.octet_length(M.bytes_of_words(F.col("words"))).cast("long").alias("size"), M.bytes_of_words(F.col("words")).alias("data"))
            fresh = fresh.unionByName(lists.where("size > 0").dropDuplicates(["fp"]))
            manifests = manifests.withColumn("base_fp", F.when(F.size("words") > 0, F.md5(M.bytes_of_words(F.col("words")))))
            folded = manifests.withColumn("words", F.when(F.col("base_fp").isNotNull(), F.transform("words", lambda _: F.lit(0).cast("long"))).otherwise(F.col("words")))
        elif base == "reuse" and not new:
            folded = self._reusing(changed, manifests)
        else:
            folded = manifests
        absent = M.lacking(fresh, "fp", self.staged_chunks()) if self.chunks.names() else fresh
        commit(absent, self.chunks)
        commit(folded.withColumn("identifier", F.uuid()).select(*[x.split()[0] for x in META.split(", ") if ":" not in x.split()[0]]), self.meta)
        return manifests

    def _reusing(self, changed: DataFrame, manifests: DataFrame) -> DataFrame:
        """Manifests folded with the base chunks of the ones before, as far as these are here."""
        own = changed.where("_base is not null").withColumn("base_fp", F.col("_base")).drop("_base")
        wanted = store(own.select(F.col("base_fp").alias("fp")).distinct(), "spool-bases")
        if wanted.isEmpty():
            return manifests
        bases = store(self.staged_chunks().unionByName(self.taken_chunks()).join(wanted, "fp", "left_semi").select(F.col("fp").alias("base_fp"), "data").dropDuplicates(["base_fp"]), "spool-bases")
        kept = own.join(bases.select("base_fp"), "base_fp", "left_semi").select(*manifests.columns)
        return M.rebased(kept, bases).unionByName(manifests.join(kept.select("db_id"), "db_id", "left_anti"))

    def _fresh(self) -> bool:
        """Whether nothing is known of any file yet."""
        return not self.meta.names() and not self.tap.names() and not self.sets()

    def taken_chunks(self) -> DataFrame:
        """Chunks of ready and consuming sets."""
        held = [read_commits(self.spark, f / "chunks", CHUNKS) for f in self.sets()]
        return functools.reduce(DataFrame.unionByName, held) if held else self.spark.createDataFrame([], CHUNKS)

    def live(self) -> DataFrame:
        """Fingerprints that the newest staged manifests need: their lists and their base chunks."""
        decoded = M.decode_and_validate(self.staged_manifests(), self.staged_chunks().unionByName(self.taken_chunks()), need_header=False)
        bases = decoded.where("base_fp is not null").select(F.col("base_fp").alias("fp"))
        return decoded.select(F.explode("fps").alias("fp")).unionByName(bases).distinct()

    def publish_ready(self) -> bool:
        """Publishes the newest manifests with those of their chunks that are staged as one ready set, unless one waits already."""
        if not self.ready.empty_or_absent() or self.meta.empty_or_absent():
            return False
        staged = M.once(self.staged_chunks(), ["fp"])
        scratch = self.root / f"ready.scratch/{uuid.uuid4().hex}"
        M.within(staged, "fp", self.live()).select("fp", "size", "data").write.parquet(f"{scratch.path}/chunks/0")
        self.staged_manifests().write.parquet(f"{scratch.path}/meta/0")
        return scratch.rename(self.ready / uuid.uuid4().hex)

    def collect_garbage(self) -> int:
        """Drops staged chunks that the newest manifests don't need; returns how many. The commits that were read are replaced by one."""
        names = self.chunks.names()
        held = read_commits(self.spark, self.chunks, CHUNKS, names).dropDuplicates(["fp"])
        live = self.live()
        gone = U.garbage(held, live).count()
        if gone:
            commit(held.join(live, "fp", "left_semi"), self.chunks)
            for name in names:
                (self.chunks / name).delete()
        return gone

    def forget_versions(self) -> None:
        """Drops all staged manifests, so that the next snapshot starts from scratch."""
        for name in self.meta.names():
            (self.meta / name).delete()

    # The copier's side.

    def claim(self) -> Folder | None:
        """A set to copy: one left in consuming by a copier that didn't finish, else the ready one, moved there."""
        if left := self.consuming.names():
            return self.consuming / left[0]
        for name in self.ready.names():
            to = self.consuming / name
            if (self.ready / name).rename(to):
                return to
        return None
