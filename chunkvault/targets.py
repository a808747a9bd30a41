"""Targets: places that hold chunks and manifests. Several are written to, and read through in order."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkvault.errors import ChunkvaultError, NotFoundError
from chunkvault.filesystem import Folder
from chunkvault.functions.names import manifest_name
from chunkvault.operators import chunks as C
from chunkvault.operators import manifests as M
from chunkvault.operators import snapshots as S
from chunkvault.spool import CHUNKS, META, commit, read_commits
from chunkvault.storage import store

#: Fixed value: hours for which a local copy of a manifest is taken for the newest.
LOCAL_HOURS = 48
HELD = f"name string, {META}, uploaded timestamp"
TOUCHES = "fp string, touched timestamp"


class Target:
    """One place. Folders are made on demand if create says so, else they must exist."""

    def __init__(self, spark: SparkSession, uri: str, create: bool = True):
        self.spark, self.root, self.create = spark, Folder(spark, uri), create
        self.chunks_at, self.manifests_at, self.touches_at = self.root / "chunks", self.root / "manifests", self.root / "touches"

    def ensure(self) -> None:
        if not self.root.exists():
            if not self.create:
                raise ChunkvaultError("bucket does not exist", uri=self.root.path.rpartition("@")[2])
            self.root.make()

    def chunks(self) -> DataFrame:
        return read_commits(self.spark, self.chunks_at, CHUNKS)

    def manifests(self) -> DataFrame:
        """The newest manifest of each name."""
        return M.once(read_commits(self.spark, self.manifests_at, HELD), ["name"], ["seq", "uploaded"])

    def put_chunks(self, chunks: DataFrame) -> None:
        """Adds chunks (fp, size, data) that the target lacks."""
        self.ensure()
        new = M.once(chunks, ["fp"])
        commit((M.lacking(new, "fp", self.chunks()) if self.chunks_at.names() else new).select("fp", "size", "data"), self.chunks_at)

    def put_manifests(self, manifests: DataFrame, now: Column) -> None:
        """Adds manifests; one that is older than what the target has changes nothing, as the newest is read."""
        self.ensure()
        named = manifests.withColumn("name", manifest_name(F.col("host"), F.col("path"))).withColumn("uploaded", now.cast("timestamp"))
        commit(named.select("name", *manifests.columns, "uploaded"), self.manifests_at)

    def touch(self, fps: DataFrame, now: Column) -> DataFrame:
        """Notes that chunks (fp) are still needed; returns those that the target lacks."""
        here = fps.select("fp").distinct().join(self.chunks().select("fp").distinct().withColumn("_here", F.lit(True)), "fp", "left")
        commit(here.where("_here").select("fp", now.cast("timestamp").alias("touched")), self.touches_at)
        return here.where("_here is null").select("fp")


@dataclass
class Tiers:
    """Where a reader looks: local taps of manifests, caches of chunks (the first is written to), then remote targets in order."""

    taps: list[DataFrame]
    caches: list[Target]
    remotes: list[Target]

    def manifests(self, names: DataFrame, now: Column) -> DataFrame:
        """Manifests of names, with the tier that has each: a tap of at most 48 hours, else the first remote."""
        local = [t.withColumn("name", manifest_name(F.col("host"), F.col("path"))).withColumn("at", F.timestamp_micros((F.col("ctime") / 1000).cast("long"))) for t in self.taps]
        remote = [t.manifests() for t in self.remotes]
        tiers = S.tiered_manifests(names, [t.select("name", "at") for t in local], [t.select("name") for t in remote], now, LOCAL_HOURS)
        columns = [f.name for f in self.remotes[0].manifests().schema if f.name != "uploaded"] if self.remotes else ["name", *[f.name for f in self.taps[0].schema]]
        tiers = store(tiers.where("tier is not null"), "tiers")
        held = [M.within(t.select(*columns), "name", tiers.where(F.col("tier") == i)).withColumn("tier", F.lit(i)) for i, t in enumerate([*local, *remote])]
        return functools.reduce(DataFrame.unionByName, held)

    def chunks(self, fps: DataFrame, known: DataFrame | None = None, granularity: int = C.GRANULARITY) -> DataFrame:
        """Rows (fp, data, tier) of distinct fingerprints: known chunks and the well-known one first, then caches, then remotes; data is null where no
        one has it. Bytes are held against their name."""
        wanted = fps.select("fp").distinct()
        zeros = wanted.sparkSession.createDataFrame([("00" * granularity,)], "h string").select(F.md5(F.unhex("h")).alias("fp"), F.unhex("h").alias("data"))
        tiers = [known.select("fp", "data").unionByName(zeros) if known is not None else zeros, *[t.chunks().select("fp", "data") for t in [*self.caches, *self.remotes]]]
        found = wanted.withColumns({"data": F.lit(None).cast("binary"), "tier": F.lit(None).cast("int")})
        # A tier is asked only for what the ones before lack; which one has what is told by names alone, and bytes stay where they are till then.
        out, left = [], store(wanted, "wanted")
        if left.isEmpty():
            return found
        for i, tier in enumerate(tiers):
            sound = tier.where(F.md5("data") == F.col("fp"))
            hits = store(sound.select("fp").join(left, "fp", "left_semi").distinct(), "tier-has")
            if not hits.isEmpty():
                out.append(M.once(M.within(sound, "fp", hits), ["fp"]).select("fp", "data", F.lit(i).alias("tier")))
                left = store(left.join(hits, "fp", "left_anti"), "wanted")
        return functools.reduce(DataFrame.unionByName, [*out, found.join(left, "fp", "left_semi").select("fp", "data", "tier")])

    def publish(self, chunks: DataFrame) -> DataFrame | None:
        """Puts chunks (fp, size, data) into the first cache: those of other caches are promoted, new ones added. Returns what was done."""
        if not self.caches:
            return None
        held = [c.chunks().select("fp") for c in self.caches[1:]]
        second = functools.reduce(DataFrame.unionByName, held) if held else self.caches[0].chunks().select("fp").limit(0)
        actions = S.cache_publish(chunks, self.caches[0].chunks(), second)
        self.caches[0].put_chunks(chunks)  # what is accepted is there, and stays
        return actions

    def decoded(self, manifests: DataFrame) -> DataFrame:
        """Manifests with their true lists; a base chunk comes from the tiers."""
        bases = self.chunks(manifests.where("base_fp is not null").select(F.col("base_fp").alias("fp"))).where("data is not null")
        return M.decode_and_validate(manifests, bases.select("fp", "data"), need_header=False)

    def places(self, manifests: DataFrame, granularity: int = C.GRANULARITY, index: Column | None = None) -> DataFrame:
        """Chunk places (db_id, chunk_index, begin, size, fp, data) of decoded manifests, or only those where index holds; bundled bytes come from the manifests."""
        # What a manifest bundles is put into its list within its row.
        own = lambda fp, i: F.get(F.filter("bundled", lambda b: (b["chunk_index"] == i) & (b["fp"] == fp)), F.lit(0))["data"]
        places = F.transform("fps", lambda fp, i: F.struct(i.cast("long").alias("chunk_index"), fp.alias("fp"), own(fp, i).alias("data")))
        lists = manifests.select("db_id", "len", F.explode(places).alias("p")).select("db_id", "len", "p.*")
        lists = lists.where(index) if index is not None else lists
        outside = lists.where("data is null").drop("data")
        fetched = outside.join(self.chunks(outside, granularity=granularity).select("fp", "data"), "fp", "left")
        whole = lists.where("data is not null").unionByName(fetched)
        begin = F.col("chunk_index") * granularity
        return whole.select("db_id", "chunk_index", begin.alias("begin"), F.least(F.lit(granularity).cast("long"), F.col("len") - begin).alias("size"), "fp", "data")

    def restored(self, manifests: DataFrame, granularity: int = C.GRANULARITY) -> DataFrame:
        """Rows (db_id, chunk_index, begin, data, valid): files chunk by chunk, to be written by range; valid tells bytes of the right size and name."""
        sound = self.decoded(manifests)
        bad = sound.where("error is not null").select("error").first()
        if bad is not None:
            raise NotFoundError(bad["error"])
        chunks = self.places(sound, granularity)
        return chunks.select("db_id", "chunk_index", "begin", "data", F.coalesce((F.octet_length("data") == F.col("size")) & (F.md5("data") == F.col("fp")), F.lit(False)).alias("valid"))
