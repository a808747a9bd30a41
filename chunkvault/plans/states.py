"""Queries over spools, tiers, counters and the texts that name them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chunkvault.functions import names as N
from chunkvault.operators import maintenance as U
from chunkvault.operators import manifests as M
from chunkvault.operators import snapshots as S
from chunkvault.operators import tracking as T
from chunkvault.operators.chunks import chunk_scan
from chunkvault.plans.catalog import CHAIN, CHUNKS, FILES, LOG, G, files, query, table, with_, write_log
from chunkvault.plans.lifecycle import DIFF, DIRTY, MANIFESTS, OLD_NEW
from chunkvault.plans.upkeep import ENCODED
from chunkvault.storage import store
from chunkvault.streaming import jobs






@query("select a.event_id, a.user_id = b.user_id and a.event_type = b.event_type as same_but_ctime, a.user_id = b.user_id and a.event_type = b.event_type and a.ts = b.ts as unchanged from events a join events b on b.event_id = a.event_id + 1")
def same_file(spark, sf):
    """File identities at two looks: equal, or equal but for the change time."""
    events = table(spark, sf, "events").select("event_id", F.struct("user_id", "event_type").alias("who"), "ts")
    later = events.select((F.col("event_id") - 1).alias("event_id"), F.col("who").alias("who_then"), F.col("ts").alias("ts_then"))
    same = F.col("who") == F.col("who_then")
    return events.join(later, "event_id").select("event_id", same.alias("same_but_ctime"), (same & (F.col("ts") == F.col("ts_then"))).alias("unchanged"))


@query("select o_orderkey from orders where timestamp '1998-08-02' - o_orderdate >= interval 2000 day")
def stale_files(spark, sf):
    return table(spark, sf, "orders").where("o_orderdate <= timestamp_ntz'1998-08-02 00:00:00' - interval 2000 days").select("o_orderkey")


@query(with_("select db_id, txn, chunk_index from dirty union select db_id, txn, 0 from log", LOG, DIRTY))
def dirty_or_bundled(spark, sf):
    log = write_log(spark, sf)
    return T.dirty_chunks(log, G).select("db_id", "txn", "chunk_index").unionByName(log.select("db_id", "txn", F.lit(0).cast("long").alias("chunk_index"))).distinct()




@query(
    with_(
        "select db_id, chunk_index from (select c.db_id, c.chunk_index, row_number() over (partition by c.db_id order by md5(c.fp || 'scrub'), c.chunk_index) as rn, any_value(d.n) over (partition by c.db_id) as n from clean c join dirty_counts d on c.db_id = d.db_id) where rn <= n",
        FILES, CHUNKS, "clean as (select * from chunks where (db_id + chunk_index) % 3 <> 0)", "dirty_counts as (select db_id, count(*) as n from chunks where (db_id + chunk_index) % 3 = 0 group by db_id)",
    )
)
def scrub_sample(spark, sf):
    """As many clean chunks to check as there are dirty ones."""
    scanned = chunk_scan(files(spark, sf), G).withColumn("dirty", (F.col("db_id") + F.col("chunk_index")) % 3 == 0)
    by_hash = W.partitionBy("db_id", "dirty").orderBy(F.md5(F.concat("fp", F.lit("scrub")).cast("binary")), "chunk_index")
    ranked = scanned.withColumn("rn", F.row_number().over(by_hash)).withColumn("n", F.count_if("dirty").over(W.partitionBy("db_id")))
    return ranked.where("not dirty and rn <= n").select("db_id", "chunk_index")


@query("select event_id from events where user_id in (select user_id from events group by user_id having sum(case when event_type = 'signup' then 1 when event_type = 'error' then -1 else 0 end) > 0)")
def active_signals(spark, sf):
    """Signals of paths in the active set; others are dropped."""
    events = table(spark, sf, "events")
    delta = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    active = U.active(events.select("user_id", delta.cast("long").alias("delta")), "user_id", "delta")
    return events.join(active, "user_id", "left_semi").select("event_id")


@query("select event_id, array_to_string(list_reverse(regexp_extract_all(lpad(lower(to_hex(event_id)), 16, '0'), '..')), '') as le_hex from events")
def words_as_bytes(spark, sf):
    big = F.regexp_extract_all(F.lpad(F.lower(F.hex("event_id")), 16, "0"), F.lit(".."), F.lit(0))
    return table(spark, sf, "events").select("event_id", F.array_join(F.reverse(big), "").alias("le_hex"))


@query("select event_id, epoch_us(ts) // 1000000 || '.' || user_id as instance, md5(event_type || chr(1) || user_id) as work_key, 'chunkvault-' || user_id || '-v2' as spool from events")
def instance_names(spark, sf):
    seconds = F.expr("unix_micros(cast(ts as timestamp)) div 1000000")
    key = F.md5(F.concat_ws("\u0001", "event_type", F.col("user_id").cast("string")).cast("binary"))
    return table(spark, sf, "events").select("event_id", F.concat_ws(".", seconds.cast("string"), F.col("user_id").cast("string")).alias("instance"), key.alias("work_key"), F.concat(F.lit("chunkvault-"), F.col("user_id").cast("string"), F.lit("-v2")).alias("spool"))


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events where event_type = 'purchase') where rn <= 2")
def last_two_uploads(spark, sf):
    last = W.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return table(spark, sf, "events").where("event_type = 'purchase'").withColumn("rn", F.row_number().over(last)).where("rn <= 2").select("user_id", "event_id")








@query(None)
def wire_roundtrip(spark, sf):
    """Manifests encoded, compressed, decoded again and compared; rows only, as SQL has no such codec."""
    from chunkvault.functions.codecs import compress, plain_or_raw
    from chunkvault.functions.wire import from_wire, to_wire

    data, size = F.col("content"), F.octet_length("content")
    fp = F.struct(F.xxhash64("content").alias("major"), F.xxhash64("path").alias("minor"))
    bundled = F.when(size > 0, F.array(F.struct(F.lit(0).cast("long").alias("chunk_index"), F.lit(0).cast("long").alias("chunk_offset"), fp.alias("chunk_fprint"), F.substring(data, 1, 64).alias("chunk_data")))).otherwise(F.array().cast("array<struct<chunk_index:bigint,chunk_offset:bigint,chunk_fprint:struct<major:bigint,minor:bigint>,chunk_data:binary>>"))
    no_fp = F.lit(None).cast("struct<major:bigint,minor:bigint>")
    m = F.struct(
        F.when(size >= 100, fp).alias("header_fprint"), F.encode("path", "utf-8").alias("version_id"), fp.alias("contents_fprint"), size.cast("long").alias("len"), F.col("db_id").alias("ctime"), (F.col("db_id") % 1000).cast("int").alias("ctime_ns"),
        no_fp.alias("base_chunks_fprint"), F.lit(b"chunkvault").alias("generated_by"), M.words(data, G).alias("chunks"), bundled.alias("bundled_chunks"),
    )
    sent = files(spark, sf).select("db_id", m.alias("m")).withColumn("raw", to_wire("m")).withColumn("blob", compress("raw"))
    back = sent.withColumn("again", from_wire(plain_or_raw("blob", F.md5("raw"))))
    return store(back.select("db_id", (F.to_json("again") == F.to_json("m")).alias("same")), "wire-roundtrip")  # in bounded batches


# The second half of August 1998: a tap is taken for 48 hours.
NOW = "1998-08-02 00:00:00"


@query(
    "select k as name, case when bool_or(kind = 0 and made between timestamp '1998-08-02' - interval 48 hour and timestamp '1998-08-02') then 0 when bool_or(kind = 1) then 1 when bool_or(kind = 2) then 2 end as tier "
    "from (select o_custkey::varchar as k, o_orderkey % 3 as kind, case when o_custkey % 3 = 0 then o_orderdate + to_days((date_diff('day', o_orderdate, timestamp '1998-08-02') - o_orderkey % 5)::int) else o_orderdate end as made from orders) group by k"
)
def tiered_manifest(spark, sf):
    """Which tier gives the manifest of each name: a local tap of at most 48 hours, else the first remote that has one."""
    k = F.col("o_orderkey")
    at = F.when(F.col("o_custkey") % 3 == 0, F.expr("cast(o_orderdate as timestamp) + make_interval(0, 0, 0, datediff(date'1998-08-02', o_orderdate) - o_orderkey % 5)")).otherwise(F.col("o_orderdate").cast("timestamp"))
    held = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("name"), (k % 3).alias("kind"), at.alias("at"))
    return S.tiered_manifests(held, [held.where("kind = 0")], [held.where("kind = 1"), held.where("kind = 2")], F.lit(NOW).cast("timestamp"))


@query(with_(f"select f.db_id, {ENCODED} as name, m.len, m.contents_fp from files f join manifests m on f.db_id = m.db_id", FILES, CHUNKS, MANIFESTS))
def manifest_by_name(spark, sf):
    """Replication info of hosts and paths, by manifest name."""
    named = files(spark, sf).select("db_id", N.manifest_name(F.col("host"), F.col("path")).alias("name"))
    held = M.build_manifests(files(spark, sf), G).join(named, "db_id").select("name", "len", "contents_fp")
    return named.join(held, "name").select("db_id", "name", "len", "contents_fp")


@query(
    with_(
        "select event_id, work, run from walk",
        "ordered as (select user_id, event_id, event_id % 9 as copied, 5 + user_id % 20 as n, row_number() over (partition by user_id order by ts, event_id) as rn from events)",
        "walk as (select user_id, event_id, rn, copied + 1 as work, (copied + 1) // 2 >= n as run from ordered where rn = 1 union all select o.user_id, o.event_id, o.rn, case when w.run then 0 else w.work end + o.copied + 1, (case when w.run then 0 else w.work end + o.copied + 1) // 2 >= o.n from walk w join ordered o on o.user_id = w.user_id and o.rn = w.rn + 1)",
        recursive=True,
    )
)
def gc_work_counter(spark, sf):
    """Work since the last collection, which runs once half of it reaches the number of chunks."""
    e = F.col("event_id")
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", (e % 9).alias("copied"), (5 + F.col("user_id") % 20).alias("n"))
    return U.work_since(events, "user_id", ["ts", "event_id"], "copied", "n")


@query(with_("select db_id, bool_or(db_id % 11 = 0 and chunk_index = 1) as mismatch, case when bool_or(db_id % 11 = 0 and chunk_index = 1) then 0 else count(*) end::bigint as backfill from chunks group by db_id", FILES, CHUNKS))
def rescan_escalation(spark, sf):
    """Every other listed chunk is read again; where the bytes have changed without a trace, the next scan starts from 0."""
    data = F.when((F.col("db_id") % 11 == 0) & (F.octet_length("content") > G), F.concat(F.substring("content", 1, G), F.lit(b"!"), F.expr(f"substring(content, {G + 2})"))).otherwise(F.col("content"))
    now = chunk_scan(files(spark, sf).withColumn("content", data), G).where("chunk_index % 2 = 1").select("db_id", "chunk_index", "fp")
    return T.rescan_from(chunk_scan(files(spark, sf), G).select("db_id", "chunk_index", "fp"), now, "db_id")


@query(with_("select chain, md5(string_agg(md5(content), '' order by db_id)) as chain_fp, max(case when prev_id is null then db_id end) as first_id from chain_files group by chain", FILES, CHAIN))
def chain_fingerprint(spark, sf):
    """A fingerprint of all versions of a chain, in order."""
    prints = files(spark, sf).select("db_id", F.md5("content").alias("f"))
    rows = M.chain(files(spark, sf)).join(prints, "db_id").groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("db_id", "f"))).alias("v"), F.max(F.when(F.col("prev_id").isNull(), F.col("db_id"))).alias("first_id"))
    return rows.select("chain", F.md5(F.array_join(F.transform("v", lambda x: x["f"]), "").cast("binary")).alias("chain_fp"), "first_id")


@query(with_("select db_id, count(*)::bigint as snapshotted, count(*) filter (where change <> 'same')::bigint as copied from diff where change <> 'removed' group by db_id", FILES, CHUNKS, CHAIN, OLD_NEW, DIFF))
def copied_counts(spark, sf):
    """How many chunks a snapshot looked at, and how many of them it had to stage."""
    from chunkvault.plans.lifecycle import manifest_diff

    return U.copied_counts(manifest_diff(spark, sf), ["db_id"])


@query("select user_id, greatest(coalesce(epoch_us(max(ts) filter (where event_type <> 'purchase')), 0) - coalesce(epoch_us(max(ts) filter (where event_type = 'purchase')), 0), 0)::bigint as lag_us from events group by user_id")
def stream_lag(spark, sf):
    """How far each file's uploads (purchases) are behind its changes, as a streaming aggregate."""
    return jobs.stream_lag(spark, f"{sf}/events.parquet", "purchase")


JITTER = 21_600_000_000


@query(
    with_(
        "select event_id from walk where kept",
        "ordered as (select user_id, event_id, epoch_us(ts) as us, (event_id * 7919) % 21600000000 as back, row_number() over (partition by user_id order by ts, event_id) as rn from events)",
        "walk as (select user_id, event_id, rn, us - back as last, true as kept from ordered where rn = 1 union all select o.user_id, o.event_id, o.rn, case when o.us - w.last > 86400000000 then o.us - o.back else w.last end, o.us - w.last > 86400000000 from walk w join ordered o on o.user_id = w.user_id and o.rn = w.rn + 1)",
        recursive=True,
    )
)
def recent_work(spark, sf):
    """Copies that are due: the last one is more than a day ago, its time being set back by its jitter."""
    events = table(spark, sf, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_id") * 7919 % JITTER).alias("back"))
    return U.fold_kept(events, ["user_id"], "event_id", "at", 86_400_000_000, "back")
