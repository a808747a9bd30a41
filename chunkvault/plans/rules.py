"""Queries over names, paths, file identities, locks and clocks, each against a table of outcomes or the rule in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkvault.functions import names as N
from chunkvault.functions import rules as R
from chunkvault.operators import maintenance as U
from chunkvault.operators import snapshots as S
from chunkvault.operators import tracking as T
from chunkvault.plans.catalog import CHUNKS, FILES, LOG, G, files, query, table, with_, write_log

# What to expect is listed case by case, not computed by the rule again.
LOCKS = (
    "outcomes(level, locked, auto, outcome, locked_after, refreshes) as (values ('none', false, false, 'ok', false, false), ('none', false, true, 'ok', false, false), ('none', true, false, 'ok', true, false), ('none', true, true, 'ok', true, false), "
    "('shared', false, false, 'ok', true, false), ('shared', false, true, 'ok', true, true), ('shared', true, false, 'ok', true, false), ('shared', true, true, 'ok', true, false), "
    + ", ".join(f"('{level}', {locked}, {auto}, 'denied', {locked}, false)" for level in ("reserved", "pending", "exclusive") for locked in ("false", "true") for auto in ("false", "true"))
    + ")"
)
ASKED = "asked as (select event_id, case event_type when 'view' then 'none' when 'click' then 'shared' when 'error' then 'reserved' when 'purchase' then 'pending' else 'exclusive' end as level, event_id % 2 = 0 as locked, event_id % 3 = 0 as auto from events)"


@query(with_("select event_id, outcome, locked_after, refreshes, case when level = 'none' then false else locked end as after_unlock from asked join outcomes using (level, locked, auto)", ASKED, LOCKS))
def replica_locks(spark, sf):
    """What a replica answers to each lock level, and whether its read lock stays after an unlock down to that level."""
    kinds = {"view": "none", "click": "shared", "error": "reserved", "purchase": "pending", "signup": "exclusive"}
    level = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
    asked = table(spark, sf, "events").select("event_id", level.alias("level"), (F.col("event_id") % 2 == 0).alias("locked"), (F.col("event_id") % 3 == 0).alias("auto"))
    found = asked.withColumn("r", R.replica_lock(F.col("level"), F.col("locked"), F.col("auto")))
    return found.select("event_id", "r.outcome", F.col("r.locked").alias("locked_after"), "r.refreshes", R.replica_unlock(F.col("level"), F.col("locked")).alias("after_unlock"))


FLAGS = "flags as (select event_id, event_id % 5 < 4 as main, case when event_id % 7 > 0 then event_type end as name, event_id % 11 = 0 as temporary, event_id % 13 = 0 as nolock, event_id % 17 = 0 as immutable from events)"


@query(with_("select event_id from events except select event_id from flags where not main or name is null or temporary or nolock or immutable", FLAGS))
def intercepted_files(spark, sf):
    e = F.col("event_id")
    flags = table(spark, sf, "events").select("event_id", (e % 5 < 4).alias("main"), F.when(e % 7 > 0, F.col("event_type")).alias("name"), (e % 11 == 0).alias("temporary"), (e % 13 == 0).alias("nolock"), (e % 17 == 0).alias("immutable"))
    return flags.where(R.intercepted(F.col("main"), F.col("name"), F.col("temporary"), F.col("nolock"), F.col("immutable"))).select("event_id")


@query("select o_orderkey, o_orderkey % 5 > 0 and (o_orderkey % 3 = 0 or (o_orderkey % 3 = 1 and o_custkey % 4 <> 1)) as moved from orders")
def moved_files(spark, sf):
    """Files by (device, inode) when opened and now: some have no path, some are gone, some are others."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    opened = N.file_key(F.lit(1), F.when(k % 3 == 1, 1).otherwise(c))
    now = F.when(k % 3 > 0, N.file_key(F.lit(1), F.when(k % 3 == 1, c % 4).otherwise(c)))
    return table(spark, sf, "orders").select("o_orderkey", R.moved(F.when(k % 5 > 0, F.lit("/db")), opened, now).alias("moved"))


FETCHES = "fetches(level, in_flight, fetches) as (values (0, false, false), (0, true, false), (1, false, true), (1, true, false), (2, false, true), (2, true, true))"


@query(with_("select event_id, fetches, fetches and event_id % 4 > 0 as switched from events join fetches on level = event_id % 3 and in_flight = (event_id % 2 = 1)", FETCHES))
def refresh_levels(spark, sf):
    """Whether a refresh fetches, by level and whether a fetch is under way, and whether its data is switched to, by read lock."""
    e = F.col("event_id")
    found = table(spark, sf, "events").select("event_id", R.refresh_fetches(e % 3, e % 2 == 1).alias("fetches"))
    return found.select("event_id", "fetches", (F.col("fetches") & R.switches(e % 4 == 0)).alias("switched"))


@query("select event_id, value > s as slow from events join (values ('view', 10), ('click', 30), ('error', 60), ('purchase', 1e9), ('signup', 1e9)) limits(event_type, s) using (event_type)")
def slow_operations(spark, sf):
    """Operations that took longer than their kind may; kinds without a limit are never slow."""
    kind = F.when(F.col("event_type") == "view", "chunk").when(F.col("event_type") == "click", "join").when(F.col("event_type") == "error", "spool").otherwise("other")
    return table(spark, sf, "events").select("event_id", R.slow(kind, F.col("value")).alias("slow"))


@query("select event_id, t <> '' and lower(left(t, 1)) not in ('0', 'f', 'n') and lower(t) <> 'off' as on_, coalesce(nullif(t, 'offset') <> '' and lower(left(t, 1)) not in ('0', 'f', 'n') and lower(t) <> 'off', t = 'offset') as with_default from (select event_id, ['off', 'OFF', 'offset', 'on', 'no', 'False', '0', '1', 'official', 'yes'][event_id % 10 + 1] as t from events)")
def bool_params(spark, sf):
    texts = F.array(*[F.lit(x) for x in ("off", "OFF", "offset", "on", "no", "False", "0", "1", "official", "yes")])
    found = table(spark, sf, "events").select("event_id", F.element_at(texts, (F.col("event_id") % 10 + 1).cast("int")).alias("t"))
    return found.select("event_id", (~N.falsy(F.col("t"))).alias("on_"), N.bool_param(F.nullif(F.col("t"), F.lit("offset")), True).alias("with_default"))


@query("select event_id, least(10.0, 0.1 * pow(2, event_id % 60 // 4))::double as sleep_ms, (50 * pow(10, event_id % 4) * (1 + (event_id % 8) / 8.0))::bigint as load_ms from events")
def lock_sleeps(spark, sf):
    """Waits: of a lock by attempt, and of a load that failed, with jitter."""
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", N.lock_sleep_ms(e % 60).alias("sleep_ms"), N.backoff_ms(50, e % 4, 1 + (e % 8) / F.lit(8.0)).alias("load_ms"))


@query(with_("select db_id, '/' || chain || '/' || db_id || '.db' as real from files", FILES))
def canonical_paths(spark, sf):
    i = F.col("db_id").cast("string")
    roundabout = F.concat(F.lit("//x/../"), F.col("chain"), F.lit("/./y/z/../../"), i, F.lit(".db/."))
    return files(spark, sf).select("db_id", N.canonical(roundabout).alias("real"))


@query(with_("select db_id, p as source, replace(replace(replace(p, '%', '%25'), 'é', '%C3%A9'), '/', '#') as folder from (select db_id, '/data/' || chain || '/é+ %' || db_id || '.db' as p from files)", FILES))
def spool_sources(spark, sf):
    """The spool folder of a file, and the file again from the folder's path."""
    path = F.concat(F.lit("/data/"), F.col("chain"), F.lit("/é+ %"), F.col("db_id").cast("string"), F.lit(".db"))
    named = files(spark, sf).select("db_id", N.mangled(path).alias("folder"))
    return named.select("db_id", N.spool_source(F.concat(F.lit("/spool/"), F.col("folder"), F.lit("/"), N.file_key(F.lit(1), F.col("db_id")))).alias("source"), "folder")


@query("select event_id, user_id || '.' || event_id as process, 8 || '.' || user_id as db_key, user_id || '.' || epoch_us(ts) || '.' || event_id || '.7' as scratch from events")
def identity_names(spark, sf):
    """Names of processes, of files by device and inode, and of scratch files."""
    return table(spark, sf, "events").select("event_id", N.process_id(F.col("user_id"), F.col("event_id")).alias("process"), N.file_key(F.lit(8), F.col("user_id")).alias("db_key"), N.scratch_name(F.col("user_id"), F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id"), F.lit(7)).alias("scratch"))


@query(with_(f"select db_id, rpad(coalesce(substr(hex(content), 2 * (db_id * 7919 % {3 * G}) + 1, 1024), ''), 1024, '0') as page from files", FILES))
def page_reads(spark, sf):
    """Pages of 512 bytes, filled up with zeros behind the end."""
    return files(spark, sf).select("db_id", F.hex(S.page_read(F.col("content"), F.col("db_id") * 7919 % (3 * G), 512)).alias("page"))


@query(with_('select db_id, max("offset" + "count")::bigint as size from log group by db_id', LOG))
def sizes_after_log(spark, sf):
    return T.sizes_after(write_log(spark, sf), "db_id")


@query(with_('select db_id, txn, min(seq)::bigint as seq from log group by all', LOG))
def version_refreshes(spark, sf):
    """The write of each transaction that gives the file a new version."""
    return T.first_writes(write_log(spark, sf), ["db_id", "txn"], "seq").select("db_id", "txn", "seq")


@query(f"select event_id from events where event_id % 5 = 0 and (event_id % 16) > 0")
def aligned_writes(spark, sf):
    """Writes of one whole chunk, but for the first: staged at once."""
    e = F.col("event_id")
    log = table(spark, sf, "events").select("event_id", ((e % 16) * G + F.when(e % 3 == 0, 0).otherwise(0)).alias("offset"), F.when(e % 5 == 0, G).otherwise(G - 1).cast("long").alias("count"))
    return T.aligned_writes(log, G).select("event_id")


@query("select o_orderkey, case when d >= 0 then d end as age_s from (select o_orderkey, (epoch(timestamp '1997-01-01') - epoch(o_orderdate))::bigint as d from orders)")
def file_ages(spark, sf):
    """Seconds since a change; none for those that lie ahead."""
    return table(spark, sf, "orders").select("o_orderkey", N.age_s(F.lit("1997-01-01 00:00:00").cast("timestamp"), F.col("o_orderdate").cast("timestamp")).alias("age_s"))


@query("select event_id, case when event_id % 3 = 0 then null else event_id + 1 end as checked, case when event_id % 3 = 0 then 9223372036854775807 else event_id + 1 end as capped, case when event_id > 500 then event_id - 500 else 0 end as floored from events")
def checked_sums(spark, sf):
    e = F.col("event_id")
    a = F.when(e % 3 == 0, F.lit((1 << 63) - 1)).otherwise(e)
    found = table(spark, sf, "events").select("event_id", a.alias("a"))
    return found.select("event_id", R.added(F.col("a"), F.lit(1).cast("long")).alias("checked"), R.saturated_sum(F.col("a"), F.lit(1).cast("long")).alias("capped"), R.saturated_difference(F.col("event_id"), F.lit(500).cast("long")).alias("floored"))


VERSION_IDS = "ids as (select db_id, case db_id % 5 when 0 then null when 1 then '' else 'u' || db_id end as attribute, case when octet_length(content) >= 100 then md5(unhex(substr(hex(content), 1, 200))) end as header from files)"


@query(with_("select db_id, coalesce(case when attribute = '' and header is null then '' else attribute || coalesce(header, '') end, '') as version, coalesce(case when attribute = '' and header is null then '' else attribute || to_hex(db_id) || coalesce(header, '') end, '') as with_ctime from ids", FILES, VERSION_IDS))
def version_ids(spark, sf):
    """Version ids of files with an attribute, with one that is absent, and on file systems that have none; with the change time mixed in too."""
    from chunkvault.operators.chunks import header_fingerprint

    attribute = F.when(F.col("db_id") % 5 == 1, "").when(F.col("db_id") % 5 > 1, F.concat(F.lit("u"), F.col("db_id").cast("string")))
    header = header_fingerprint(F.col("content"))
    return files(spark, sf).select("db_id", R.version_id(attribute, header).alias("version"), R.version_id(attribute, header, F.col("db_id")).alias("with_ctime"))


@query("select o_custkey, stale, row_number() over (order by stale desc, md5(o_custkey::varchar) desc)::bigint as nth from (select o_custkey, bool_or(o_orderstatus = 'F' and o_orderkey % 7 = 0) as stale from orders group by o_custkey)")
def background_scan(spark, sf):
    """The order of a background scan: stale ones first, the rest shuffled."""
    active = table(spark, sf, "orders").groupBy("o_custkey").agg(F.bool_or((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 7 == 0)).alias("stale"))
    return U.background_order(active, "stale", F.md5(F.col("o_custkey").cast("string").cast("binary"))).select("o_custkey", "stale", "nth")


@query("select batch, user_id, first from (select *, row_number() over (partition by batch order by first, user_id) as nth from (select event_id // 200 as batch, user_id, min(event_id) as first from events group by all)) where nth <= 20")
def bounded_queue(spark, sf):
    """Signals that a queue of 20 takes between two drains; those that find it full are dropped."""
    signals = table(spark, sf, "events").select(F.expr("event_id div 200").alias("batch"), "user_id", F.col("event_id").alias("first"))
    return U.queued(signals, ["user_id"], "batch", ["first"], 20).select("batch", "user_id", "first")


@query(with_("select fp, case when bool_or(db_id % 3 = 0) then 'accept' when bool_or(db_id % 3 = 1) then 'promote' else 'add' end as action from chunks group by fp", FILES, CHUNKS))
def cache_publish(spark, sf):
    """What publishing to a cache of two tiers does with each chunk."""
    from chunkvault.operators.chunks import chunk_scan

    scanned = chunk_scan(files(spark, sf), G)
    return S.cache_publish(scanned, scanned.where("db_id % 3 = 0"), scanned.where("db_id % 3 = 1"))


@query(
    "select worker, count(*) filter (where kind = 'edge')::bigint as edge, count(*) filter (where kind = 'lag')::bigint as lag, count(*) filter (where kind = 'upkeep')::bigint as upkeep from "
    "(select user_id % 10 as worker, case event_type when 'click' then 'edge' else 'lag' end as kind from events where event_type in ('click', 'error') union all select 5 + user_id % 5, 'upkeep' from events where event_type = 'view') group by worker"
)
def merged_work(spark, sf):
    """Edge, lag and upkeep work dealt to ten workers, of which the first half does no upkeep."""
    events = table(spark, sf, "events")
    kinds = {"edge": "click", "lag": "error", "upkeep": "view"}
    merged = events.withColumn("kind", F.lit(None).cast("string")).where("false")
    for kind, event in kinds.items():
        merged = merged.unionByName(events.where(F.col("event_type") == event).withColumn("kind", F.lit(kind)))
    dealt = U.dealt(merged, "kind", F.col("user_id"), 10)
    return dealt.groupBy("worker").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
