"""Queries that run the engine end to end: files are spooled, copied to targets, read back through tiers, refreshed and recovered."""

from __future__ import annotations

import datetime
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkvault.copier import Copier
from chunkvault.errors import ChunkvaultError, LockedError
from chunkvault.functions.names import manifest_name
from chunkvault.operators import manifests as M
from chunkvault.operators.chunks import header_fingerprint
from chunkvault.plans.catalog import CHUNKS, FILES, G, files, query, with_
from chunkvault.plans.lifecycle import MANIFESTS
from chunkvault.replica import Replica
from chunkvault.spool import Spool
from chunkvault.storage import fresh_path, store
from chunkvault.targets import Target, Tiers

#: A time later than all fixtures, for clocks that must not move.
NOON = 1_767_225_600.0


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """Files with a version and a change time: db_id seconds before noon."""
    version = F.coalesce(header_fingerprint(F.col("content")), F.lit(""))
    return files(spark, sf).withColumns({"version": version, "ctime": (F.lit(int(NOON)) - F.col("db_id")) * 1_000_000_000}).drop("chain")


def replication(spark: SparkSession, remotes: int = 2, **settings) -> tuple[Spool, Copier, list[str]]:
    """An empty spool with so many remote targets and a cache, and a copier whose clock stands still."""
    at = fresh_path(spark, "replication")
    places = [f"{at}/remote-{i}" for i in range(remotes)]
    spool = Spool(spark, f"{at}/spool", G)
    spool.write_targets([*({"s3": {"directory": p}} for p in places), {"local": {"directory": f"{at}/cache"}}])
    return spool, Copier(spark, clock=lambda: NOON, sleep=lambda _: None, **settings), places


def held(spark: SparkSession, place: str) -> DataFrame:
    """What a target has: rows (db_id, len, n_chunks, contents_fp), each list folded out and checked against chunks of that target alone."""
    target = Target(spark, place)
    found = M.decode_and_validate(target.manifests(), target.chunks(), need_header=False).where("error is null")
    return found.select("db_id", "len", F.size("fps").cast("long").alias("n_chunks"), "contents_fp")


ON_TARGETS = "select t.target::int as target, m.db_id, m.len, m.n_chunks, m.contents_fp from manifests m, (values (0), (1)) t(target)"


@query(with_(ON_TARGETS, FILES, CHUNKS, MANIFESTS))
def copier_states(spark, sf):
    """Half of the files are spooled and made ready, then all are spooled; one pass of the copier brings all to both targets."""
    spool, copier, places = replication(spark)
    state, own = copier.join(spool), sources(spark, sf)
    spool.stage(own.where("db_id % 2 = 0"))
    spool.publish_ready()
    spool.stage(own)
    copier.work(state)
    return functools.reduce(DataFrame.unionByName, [held(spark, p).withColumn("target", F.lit(i)) for i, p in enumerate(places)])


STEPS = ("claim", "chunks", "manifests", "tap")


@query(with_("select db_id, len, n_chunks, contents_fp, ['claim', 'chunks', 'manifests', 'tap'][db_id % 4 + 1] as lost_after from manifests", FILES, CHUNKS, MANIFESTS))
def crash_recovery(spark, sf):
    """Copiers that are lost after each of their steps; another one finishes what they left."""
    out = []
    for i, step in enumerate(STEPS):
        spool, lost, (place,) = replication(spark, 1)
        spool.stage(sources(spark, sf).where(F.col("db_id") % 4 == i))
        spool.publish_ready()
        lost.stop_after = step
        try:
            lost.handle(lost.join(spool))
        except ChunkvaultError as e:
            if e.context != {"step": step}:
                raise
        copier = Copier(spark, clock=lambda: NOON, sleep=lambda _: None)
        copier.handle(copier.join(spool))
        out.append(held(spark, place).withColumn("lost_after", F.lit(step)))
    return functools.reduce(DataFrame.unionByName, out)


@query(with_("select db_id, (octet_length(content) - case when db_id % 3 = 0 then least(octet_length(content), 10) else 0 end)::bigint as len, (db_id % 3 = 0)::int::bigint as seq from files", FILES))
def staged_look(spark, sf):
    """Files that change between the copier's first look at staging and its upload are left for the next pass, which then uploads them."""
    spool, copier, (place,) = replication(spark, 1, draw=lambda: 0.0)
    state, own = copier.join(spool), store(sources(spark, sf), "sources")
    spool.stage(own, "none")
    cut = own.where("db_id % 3 = 0").withColumn("content", F.expr("substring(content, 1, octet_length(content) - 10)")).withColumn("version", F.concat("version", F.lit("-")))
    copier.hooks["look"] = lambda: spool.stage(cut, "none")
    if copier.handle_staging(state):
        raise ChunkvaultError("uploaded what had changed")
    copier.hooks.clear()
    copier.handle(state)
    return Target(spark, place).manifests().select("db_id", "len", "seq")


@query(with_("select db_id, n_chunks, len, contents_fp, true as valid from manifests", FILES, CHUNKS, MANIFESTS))
def tiered_restore(spark, sf):
    """Files restored through a cache that lacks half of the chunks, a remote that lacks a third, and one that has all but damaged copies of some."""
    spool, copier, (place,) = replication(spark, 1)
    spool.stage(sources(spark, sf), "refresh")
    copier.flush(spool)
    whole = Target(spark, place)
    part = [Target(spark, f"{place}-{i}") for i in range(2)]
    part[0].put_chunks(whole.chunks().where("substring(fp, 1, 1) < '8'"))
    part[1].put_chunks(whole.chunks().where("substring(fp, 1, 1) > '4'").withColumn("data", F.when(F.col("fp").endswith("0"), F.lit(b"damaged")).otherwise(F.col("data"))))
    tiers = Tiers([], part[:1], [part[1], whole])
    names = sources(spark, sf).select(manifest_name(F.col("host"), F.col("path")).alias("name"))
    manifests = store(tiers.manifests(names, F.lit(datetime.datetime.fromtimestamp(NOON, datetime.UTC))).drop("tier"), "manifests")
    chunks = tiers.restored(manifests, G).withColumn("fp", F.md5("data"))
    made = chunks.groupBy("db_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.octet_length("data")).alias("len"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "fp"))), lambda x: x["fp"]), "").cast("binary")).alias("contents_fp"), F.every("valid").alias("valid"))
    out = manifests.select("db_id").join(made, "db_id", "left")
    return out.select("db_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("len", F.lit(0)).cast("long").alias("len"), F.coalesce("contents_fp", F.md5(F.lit("").cast("binary"))).alias("contents_fp"), F.coalesce("valid", F.lit(True)).alias("valid"))


DECODED = "case when db_id % 7 = 1 then 'missing contents_fp' when db_id % 7 = 2 or header_fp is null then 'missing header_fp' when n_chunks > 0 and db_id % 7 = 3 then 'base chunk not found' when n_chunks > 0 and db_id % 7 = 4 then 'base chunk has invalid size' when db_id % 7 = 5 then 'invalid chunk list' end"


@query(with_(f"select db_id, {DECODED} as error, case when {DECODED} is null then n_chunks end as n_chunks, case when {DECODED} is null then contents_fp end as contents_fp from manifests", FILES, CHUNKS, MANIFESTS))
def manifest_decode(spark, sf):
    """Manifests against their base chunks, some of them damaged in one way each: what is wrong, or the list that was folded out."""
    kind = F.col("db_id") % 7
    made = M.manifest_rows(sources(spark, sf).withColumn("seq", F.lit(0).cast("long")), G)
    based = made.withColumn("base", M.bytes_of_words(F.col("words"))).withColumn("base_fp", F.when(F.size("words") > 0, F.md5("base")))
    stored = based.where((F.size("words") > 0) & (kind != 3)).select(F.col("base_fp").alias("fp"), F.col("base").alias("data"), kind.alias("kind"))
    bad = based.where((kind == 4) & (F.size("words") > 0)).select(F.md5(F.concat(F.col("base_fp"), F.lit("odd"))).alias("fp"), F.lit(b"odd").alias("data"))
    chunks = stored.select("fp", "data").unionByName(bad).dropDuplicates(["fp"])
    zero = F.when(F.col("base_fp").isNotNull(), F.transform("words", lambda _: F.lit(0).cast("long"))).otherwise(F.col("words"))
    lost = F.when(kind == 3, F.md5(F.concat(F.col("base_fp"), F.lit("lost")))).when(kind == 4, F.md5(F.concat(F.col("base_fp"), F.lit("odd")))).otherwise(F.col("base_fp"))
    sent = based.withColumn("words", zero).withColumn("contents_fp", F.when(kind == 1, None).when(kind == 5, F.md5("contents_fp")).otherwise(F.col("contents_fp")))
    sent = sent.withColumn("header_fp", F.when(kind != 2, F.col("header_fp"))).withColumn("base_fp", lost).drop("base")
    found = M.decode_and_validate(sent, chunks)
    sound = F.col("error").isNull()
    return found.select("db_id", "error", F.when(sound, F.size("fps").cast("long")).alias("n_chunks"), F.when(sound, F.md5(F.array_join("fps", "").cast("binary"))).alias("contents_fp"))


VERSIONS = "versions as (select row_number() over (order by db_id) as nth, md5(content) as digest from files where chain = (select min(chain) from files))"


@query(with_("select step::int as step, what, digest from (values (0, 'opened', 1), (1, 'level 0', 1), (2, 'async, in memory', 2), (3, 'locked', 2), (4, 'level 1', 3), (5, 'read lock', 4)) t(step, what, nth) join versions using (nth)", FILES, VERSIONS))
def refresh_replica(spark, sf):
    """A replica of a file that changes four times: opened, refreshed from memory, reloaded in the background, under a read lock, by force, and by itself
    at a read lock. It reads the bytes of the version that it should."""
    chain = files(spark, sf)
    first = chain.agg(F.min("chain")).first()[0]
    versions = [bytes(r["content"]) for r in chain.where(F.col("chain") == first).orderBy("db_id").limit(4).select("content").collect()]  # four files
    spool, copier, (place,) = replication(spark, 1)
    at = datetime.datetime.fromtimestamp(NOON, datetime.UTC)

    def upload(i: int) -> None:
        row = spark.createDataFrame([(7, "host", "/db", f"v{i}", int(NOON) * 10**9 + i, versions[i])], "db_id long, host string, path string, version string, ctime long, content binary")
        spool.stage(row)
        copier.flush(spool)

    tiers = lambda: Tiers([], [], [Target(spark, place)])
    upload(0)
    seen, replica = [], Replica(tiers, manifest_name_of(spark, "host", "/db"), G, lambda: at)
    digest = lambda r: spark.createDataFrame([(r.read(0, 1 << 40),)], "b binary").select(F.md5("b")).first()[0]
    seen.append((0, "opened", digest(replica)))
    upload(1)
    replica.refresh(0)
    seen.append((1, "level 0", digest(replica)))
    if replica.async_reload():
        raise ChunkvaultError("nothing newer was in memory")
    replica.data.done.result()
    replica.async_reload()
    seen.append((2, "async, in memory", digest(replica)))
    upload(2)
    replica.lock("shared")
    try:
        replica.refresh(2)
    except LockedError:
        seen.append((3, "locked", digest(replica)))
    replica.unlock()
    replica.refresh(1)
    seen.append((4, "level 1", digest(replica)))
    upload(3)
    other = Replica(tiers, replica.name, G, lambda: at)
    other.refresh(2)
    replica.auto_refresh = True
    replica.lock("shared")
    seen.append((5, "read lock", digest(replica)))
    replica.close()
    return spark.createDataFrame(seen, "step int, what string, digest string")


def manifest_name_of(spark: SparkSession, host: str, path: str) -> str:
    return spark.range(1).select(manifest_name(F.lit(host), F.lit(path))).first()[0]


@query(with_("select host, count(*)::bigint as stale, 0::bigint as maybe_stale, (count(*) + any_value(up))::bigint as tracked from files join (select host, count(*) as up from files where db_id % 2 = 0 group by host) u using (host) where db_id % 2 = 1 group by host", FILES))
def copier_lag(spark, sf):
    """Lag of files after half of them were uploaded; the others count as stale."""
    spool, copier, _ = replication(spark, 1)
    own = store(sources(spark, sf).withColumn("ctime", F.col("ctime") - 10**12), "sources")
    spool.stage(own.where("db_id % 2 = 0"))
    copier.flush(spool)
    heads = own.select("db_id", "host", "ctime", header_fingerprint(F.col("content")).alias("header_fp"))
    from chunkvault.operators import maintenance as U

    lags, _ = copier.lag(spool, heads)
    hosts = [r["host"] for r in heads.select("host").distinct().collect()]  # a handful of languages
    joined = lags.join(heads.select("db_id", "host"), "db_id")
    counts = [U.lag_counts(joined.where(F.col("host") == h), F.lit(datetime.datetime.fromtimestamp(NOON, datetime.UTC)).cast("timestamp")).withColumn("host", F.lit(h)) for h in hosts]
    return functools.reduce(DataFrame.unionByName, counts).select("host", "stale", "maybe_stale", "tracked")


@query(with_("select count(distinct fp)::bigint as missing, 0::bigint as staged from chunks where chunk_index > 0 and substr(fp, 1, 1) < '4'", FILES, CHUNKS))
def patrol_finds_losses(spark, sf):
    """A target that lost chunks: a patrol over a whole day finds them, and staged manifests go, so that the next snapshot is full."""
    spool, copier, (place,) = replication(spark, 1)
    spool.stage(sources(spark, sf), "none")
    copier.flush(spool)
    target = Target(spark, place)
    kept = store(target.chunks().where("substring(fp, 1, 1) >= '4'"), "kept")
    target.chunks_at.delete()
    target.put_chunks(kept)
    missing = copier.patrol(spool, 86_400.0)
    if missing:
        spool.forget_versions()
    return spark.createDataFrame([(missing, spool.staged_manifests().count())], "missing long, staged long")
