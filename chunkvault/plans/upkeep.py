"""Queries over sinks, states, maintenance, names and texts, and the streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkvault.functions import names as N
from chunkvault.functions import rules as R
from chunkvault.operators import maintenance as U
from chunkvault.operators import manifests as M
from chunkvault.operators.chunks import chunk_scan
from chunkvault.plans.catalog import CHUNKS, FILES, LOG, G, files, query, table, with_, write_log
from chunkvault.plans.lifecycle import DIRTY
from chunkvault.storage import store
from chunkvault.streaming import jobs


def _chunks(spark, sf):
    return chunk_scan(files(spark, sf), G)


@query(with_("select distinct fp from chunks where db_id % 4 < 3 and fp in (select fp from chunks where db_id % 4 > 1)", FILES, CHUNKS))
def ready_buffer(spark, sf):
    scanned = _chunks(spark, sf)
    return U.ready(scanned.where("db_id % 4 < 3"), scanned.where("db_id % 4 > 1"))


@query(with_("select distinct fp from chunks where db_id % 4 < 3 and fp not in (select fp from chunks where db_id % 4 > 1)", FILES, CHUNKS))
def gc_chunks(spark, sf):
    scanned = _chunks(spark, sf)
    return U.garbage(scanned.where("db_id % 4 < 3"), scanned.where("db_id % 4 > 1"))



@query("select event_id, (event_id % 9 >= (event_id * 31) % ((user_id // 4) + 1)) or ((event_id % 50) // 2 >= user_id) as collect from events")
def gc_partial_decision(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", U.partial_collection(e % 9, e % 50, F.col("user_id"), e * 31).alias("collect"))



TARGETS_SCHEMA = "replication_targets array<struct<s3:struct<region:string,chunk_bucket:string,manifest_bucket:string>,local:struct<directory:string,num_shards:int,capacity:bigint>,read_only:struct<directory:string>>>"
TARGETS = "targets as (select n_regionkey as owner, n_nationkey as pos, case n_nationkey % 3 when 0 then 's3' when 1 then 'local' else 'read_only' end as kind from nation)"


@query(with_("select owner, pos, kind, case when kind = 'read_only' or rn > 1 then 'reader' else 'writer' end as role from (select *, row_number() over (partition by owner, kind order by pos) as rn from targets) where kind <> 's3'", TARGETS))
def targets_roles(spark, sf):
    kind = F.element_at(F.array(F.lit("s3"), F.lit("local"), F.lit("read_only")), F.col("n_nationkey") % 3 + 1)
    targets = table(spark, sf, "nation").select(F.col("n_regionkey").alias("owner"), F.col("n_nationkey").alias("pos"), kind.alias("kind"))
    return U.roles(targets, "owner", "pos", "kind")


@query("select o_custkey as path, max_by(o_orderkey, (o_orderdate, o_orderkey)) as spool from orders group by o_custkey")
def newest_spool(spark, sf):
    spools = table(spark, sf, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("spool"))
    return U.newest(spools, "path", "at").select("path", "spool")


LAG = "lag as (select o_orderkey as db_id, o_orderdate as source_at, r.at as replicated_at, o_orderkey % 3 = 0 and r.at is not null as headers_match from orders left join (select l_orderkey, max(l_shipdate) - interval 60 day as at from lineitem group by l_orderkey) r on l_orderkey = o_orderkey)"
LAGS = "lags as (select db_id, headers_match, case when replicated_at is null then epoch(source_at)::bigint when source_at > replicated_at then (epoch(source_at) - epoch(replicated_at))::bigint else 0 end as lag_s, coalesce(source_at > replicated_at, true) and not headers_match as stale from lag)"


def _lag(spark, sf):
    key = F.col("o_orderkey")
    sources = table(spark, sf, "orders").select(key.alias("db_id"), F.col("o_orderdate").cast("timestamp").alias("source_at"), (key % 3 == 0).alias("source_header"))
    done = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("db_id")).agg((F.max("l_shipdate") - F.expr("interval 60 days")).cast("timestamp").alias("replicated_at")).withColumn("header", F.lit(True))
    return U.lag(sources, done, "db_id")


@query(with_("select * from lags", LAG, LAGS))
def lag_report(spark, sf):
    return _lag(spark, sf).select("db_id", "headers_match", F.col("lag_s").cast("long").alias("lag_s"), "stale")



OUTCOMES = "outcomes as (select user_id, event_id, ts, case event_type when 'purchase' then 'update' when 'error' then 'failure' else 'success' end as kind from events)"


def _outcomes(spark, sf):
    kind = F.when(F.col("event_type") == "purchase", "update").when(F.col("event_type") == "error", "failure").otherwise("success")
    return table(spark, sf, "events").select("user_id", "event_id", "ts", kind.alias("kind"))


@query(with_("select event_id, kind, row_number() over (partition by user_id, kind, island order by ts, event_id)::bigint as streak from (select *, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, kind order by ts, event_id) as island from outcomes)", OUTCOMES))
def outcome_streaks(spark, sf):
    return U.streaks(_outcomes(spark, sf), "user_id", ["ts", "event_id"], "kind").select("event_id", "kind", "streak")


@query("select user_id, sum(case when event_type = 'signup' then 1 when event_type = 'error' then -1 else 0 end)::bigint as refs from events group by user_id having refs > 0")
def refcount_active(spark, sf):
    delta = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return U.active(table(spark, sf, "events").select("user_id", delta.cast("long").alias("delta")), "user_id", "delta")


DAY = 86_400_000_000


def _throttle_sql(key: str, gap: int) -> str:
    """A recursive walk from each kept event to the first one at least gap later."""
    ordered = f"ordered as (select {key}, event_id, epoch_us(ts) as us, row_number() over (partition by {key} order by ts, event_id) as rn from events)"
    walk = f"walk as (select {key}, event_id, us, rn, us as last, true as kept from ordered where rn = 1 union all select {', '.join('o.' + k.strip() for k in key.split(','))}, o.event_id, o.us, o.rn, case when o.us - w.last >= {gap} then o.us else w.last end, o.us - w.last >= {gap} from walk w join ordered o on {' and '.join(f'o.{k.strip()} = w.{k.strip()}' for k in key.split(','))} and o.rn = w.rn + 1)"
    return with_("select event_id from walk where kept", ordered, walk, recursive=True)


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))


@query(_throttle_sql("user_id, event_type", DAY))
def throttled_dedup(spark, sf):
    return U.fold_kept(_events(spark, sf), ["user_id", "event_type"], "event_id", "at", DAY).select("event_id")


@query(_throttle_sql("user_id", DAY // 4))
def min_interval_throttle(spark, sf):
    return U.fold_kept(_events(spark, sf), ["user_id"], "event_id", "at", DAY // 4).select("event_id")


HOUR = 3_600_000_000


@query(
    with_(
        "select event_id, ok as granted from walk",
        "ordered as (select user_id, event_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as rn from events)",
        f"walk as (select user_id, event_id, us, rn, {3 * 6 * HOUR}::bigint - {6 * HOUR} as level, true as ok from ordered where rn = 1 union all select user_id, event_id, us, rn, case when up >= {6 * HOUR} then up - {6 * HOUR} else up end, up >= {6 * HOUR} from (select o.*, least({3 * 6 * HOUR}, w.level + o.us - w.us)::bigint as up from walk w join ordered o on o.user_id = w.user_id and o.rn = w.rn + 1))",
        recursive=True,
    )
)
def token_bucket(spark, sf):
    return U.token_bucket(_events(spark, sf), "user_id", "event_id", "at", 6 * HOUR, 3).select("event_id", "granted")


@query("select distinct event_id // 100 as batch, user_id as db_id from events")
def edge_coalesce(spark, sf):
    return table(spark, sf, "events").select(F.expr("event_id div 100").alias("batch"), F.col("user_id").alias("db_id")).dropDuplicates(["batch", "db_id"])


@query("select source as chain, doc_id as db_id, ((row_number() over (partition by source order by doc_id) - 1) // 10)::bigint as batch from documents")
def upload_batches(spark, sf):
    return U.batches(files(spark, sf).select("chain", "db_id"), "chain", ["db_id"])



STATUS = "reqs as (select event_id, 200 + event_id % 400 as status, user_id % 5 as attempt from events)"


def _requests(spark, sf):
    return table(spark, sf, "events").select("event_id", (200 + F.col("event_id") % 400).alias("status"), (F.col("user_id") % 5).alias("attempt"))


@query(with_("select event_id, case when status between 200 and 299 then 'ok' when status < 500 and status not in (408, 429) then 'permanent' when attempt < 3 then 'retry' else 'failed' end as next from reqs", STATUS))
def put_outcome(spark, sf):
    return _requests(spark, sf).select("event_id", U.put_outcome(F.col("status"), F.col("attempt")).alias("next"))


@query(with_("select event_id, case when status = 200 then 'data' when status = 404 and attempt >= 1 then 'missing' when status < 500 and status not in (404, 429) then 'failed' when attempt < 3 then 'retry' else 'failed' end as next from reqs", STATUS))
def get_outcome(spark, sf):
    return _requests(spark, sf).select("event_id", U.get_outcome(F.col("status"), F.col("attempt")).alias("next"))


@query(with_("select event_id, case when status between 200 and 299 then 'ok' when status = 404 then 'full_snapshot' when status < 500 then 'ignored' when attempt < 3 then 'retry' else 'ignored' end as next from reqs", STATUS))
def touch_outcome(spark, sf):
    return _requests(spark, sf).select("event_id", U.touch_outcome(F.col("status"), F.col("attempt")).alias("next"))


@query(with_("select event_id // 3 as blob, bool_and(status between 200 and 299) as everywhere from reqs group by blob", STATUS))
def all_targets_ok(spark, sf):
    return _requests(spark, sf).groupBy(F.expr("event_id div 3").alias("blob")).agg(F.every(F.col("status").between(200, 299)).alias("everywhere"))


@query("select event_id, (50 * 10 ** (event_id % 4))::bigint as load_ms, (100 * 10 ** (event_id % 4))::bigint as copy_ms from events")
def backoff_schedule(spark, sf):
    nth = F.col("event_id") % 4
    return table(spark, sf, "events").select("event_id", N.backoff_ms(50, nth).alias("load_ms"), N.backoff_ms(100, nth).alias("copy_ms"))


@query(with_("select distinct fp, substr(fp, 1, 16) || '%2F' || substr(fp, 17, 16) as name, fp as again from chunks", FILES, CHUNKS))
def chunk_names(spark, sf):
    named = _chunks(spark, sf).select("fp").distinct().withColumn("name", N.chunk_name(F.col("fp")))
    return named.withColumn("again", N.chunk_name_fp(F.col("name")))


ENCODED = "replace(replace(replace(substr(md5(host), 1, 4) || '-chunkvault:' || host || ':' || substr(md5(path), 1, 4) || '/' || path, '%', '%25'), ':', '%3A'), '/', '%2F')"


@query(with_(f"select db_id, {ENCODED} as name from files", FILES))
def manifest_names(spark, sf):
    return files(spark, sf).select("db_id", N.manifest_name(F.col("host"), F.col("path")).alias("name"))



URIS = "uris as (select page_id, case page_id % 5 when 0 then url when 1 then 's3://bucket.us-east-1/' || page_id when 2 then 'replica://host/' || page_id when 3 then 'file:///tmp/' || page_id else '/tmp/' || page_id end as uri from pages)"


@query(with_("select page_id, case when regexp_matches(uri, '^https?://') then 'http' when uri like 's3://%' then 's3' when uri like 'replica://%' then 'replica' when uri like 'file://%' then 'file' else 'path' end as reader, regexp_extract(uri, '^s3://([^./]+)\\.([^/]+)/(.*)$', 1) as bucket, regexp_extract(uri, '^s3://([^./]+)\\.([^/]+)/(.*)$', 2) as region from uris", URIS))
def uri_dispatch(spark, sf):
    i, p = F.col("page_id"), F.col("page_id").cast("string")
    uri = F.when(i % 5 == 0, F.col("url")).when(i % 5 == 1, F.concat(F.lit("s3://bucket.us-east-1/"), p)).when(i % 5 == 2, F.concat(F.lit("replica://host/"), p)).when(i % 5 == 3, F.concat(F.lit("file:///tmp/"), p)).otherwise(F.concat(F.lit("/tmp/"), p))
    bucket, region, _ = N.s3_parts(F.col("uri"))
    return table(spark, sf, "pages").select("page_id", uri.alias("uri")).select("page_id", N.source_kind(F.col("uri")).alias("reader"), bucket.alias("bucket"), region.alias("region"))




# The keys of the policy format.
POLICIES = "policies as (select event_id, case event_id % 4 when 0 then '\"default\"' when 1 then '{\"eager\": null}' when 2 then '{\"partial\": {}}' else '{\"partial\": {\"min\": 1, \"max\": 10}}' end as p from events)"


@query(with_("select event_id, case event_id % 4 when 0 then 'default' when 1 then 'eager' else 'partial' end as policy, case when event_id % 4 = 3 then 3::bigint end as least, case when event_id % 4 = 3 then 25::bigint end as most from policies", POLICIES))
def json_policy(spark, sf):
    texts = F.array(*[F.lit(x) for x in ('"default"', '{"eager": null}', '{"partial": {}}', '{"partial": {"min": 3, "max": 25}}')])
    rows = table(spark, sf, "events").select("event_id", F.element_at(texts, (F.col("event_id") % 4 + 1).cast("int")).alias("p"))
    parsed = F.from_json("p", "partial struct<min: bigint, max: bigint>")["partial"]
    kind = F.when(F.col("p").startswith('"'), F.regexp_replace("p", '"', "")).otherwise(F.regexp_extract("p", r'^\{"(\w+)"', 1))
    return rows.select("event_id", kind.alias("policy"), parsed["min"].alias("least"), parsed["max"].alias("most"))


@query("select event_id, 96000000 + event_id as tick from events")
def stat_line_parse(spark, sf):
    e = F.col("event_id").cast("string")
    line = F.concat(e, F.lit(" (a (b) "), F.col("event_type"), F.lit("\n) S "), F.repeat(F.lit("7 "), 18), (F.col("event_id") + 96000000).cast("string"), F.lit(" 0 0"))
    return table(spark, sf, "events").select("event_id", N.birth_tick(line).alias("tick"))



@query("select event_id, event_id + d as ts, rank::int as rank from events, (values (0, 0), (1, -1), (2, 1), (3, -2), (4, 2)) v(rank, d)")
def candidate_instances(spark, sf):
    return table(spark, sf, "events").select("event_id", F.posexplode(N.candidate_ids(F.col("event_id"))).alias("rank", "ts")).select("event_id", "ts", "rank")


@query("select event_id, ((user_id * 4294967296) + event_id)::bigint as packed, user_id as hi, event_id as lo from events")
def packed_pairs(spark, sf):
    packed = F.shiftleft(F.col("user_id"), 32).bitwiseOR(F.col("event_id"))
    return table(spark, sf, "events").select("event_id", packed.alias("packed")).select("event_id", "packed", F.shiftright("packed", 32).alias("hi"), F.col("packed").bitwiseAND(F.lit((1 << 32) - 1)).alias("lo"))


@query(None)
def zstd_arbitration(spark, sf):
    """Blobs that may be compressed, and a raw one that only looks so; rows only, as SQL has no such codec."""
    from chunkvault.functions.codecs import compress, plain_or_raw

    blobs = files(spark, sf).select("db_id", "content", F.md5("content").alias("fp"))
    blobs = blobs.withColumn("blob", F.when(F.col("db_id") % 3 == 0, compress(F.col("content"))).otherwise(F.col("content")))
    # Stored here, as only then Python gets batches of bounded bytes: else those of 10,000 texts at a time, copied at each step.
    return store(blobs.select("db_id", (plain_or_raw(F.col("blob"), F.col("fp")) == F.col("content")).alias("same")), "zstd-arbitration")


@query(with_("select fp from chunks where db_id % 2 = 0 union select md5(unhex(string_agg(le, '' order by chunk_index))) from (select db_id, chunk_index, array_to_string(list_reverse(regexp_extract_all(substr(fp, 1, 16), '..')), '') || array_to_string(list_reverse(regexp_extract_all(substr(fp, 17, 16), '..')), '') as le from chunks where db_id % 2 = 0) group by db_id", FILES, CHUNKS))
def live_set(spark, sf):
    """Fingerprints that manifests need: of their chunks, and of their base chunks, the lists' bytes."""
    own = files(spark, sf).where("db_id % 2 = 0")
    base = own.select(F.md5(M.bytes_of_words(M.words(F.col("content"), G))).alias("fp")).where(F.octet_length("content") > 0)
    return chunk_scan(own, G).select("fp").union(base).distinct()


@query("select c_custkey as db_id from customer where c_custkey not in (select o_custkey from orders) and c_custkey % 48 >= 24")
def orphan_taps(spark, sf):
    """Taps of files that are gone, a day old at least."""
    taps = table(spark, sf, "customer").select(F.col("c_custkey").alias("db_id"), F.expr("timestamp'2024-01-03 00:00:00' - make_interval(0, 0, 0, 0, cast(c_custkey % 48 as int))").alias("at"))
    live = table(spark, sf, "orders").select(F.col("o_custkey").alias("db_id"))
    return U.orphans(taps, live, "db_id", "at", F.lit("2024-01-03 00:00:00").cast("timestamp")).select("db_id")


@query(
    with_(
        "select count(*) filter (where late and not headers_match)::bigint as stale, count(*) filter (where late and headers_match)::bigint as maybe_stale, count(*)::bigint as tracked from (select *, coalesce(source_at > replicated_at, true) and timestamp '1998-07-01' - source_at >= interval 120 second as late from lag)",
        LAG,
    )
)
def stale_counts(spark, sf):
    """Sources whose replica is behind, and which changed 120 seconds ago or earlier."""
    return U.lag_counts(_lag(spark, sf), F.lit("1998-07-01 00:00:00").cast("timestamp"))


PATROL = "wanted as (select chain, fp, rn, n, n * least(greatest((3600.0 * (n % 30))::double / 86400, 0), 1) as w, (n % 10) / 10.0::double as draw from (select chain, fp, row_number() over (partition by chain order by md5(fp || 'patrol'), fp) as rn, count(*) over (partition by chain) as n from (select distinct chain, fp from chunks)))"


@query(with_("select chain, fp from wanted where rn <= least(floor(w) + case when draw < least((w - floor(w)) * 2, 1) then 1 else 0 end, n)", FILES, CHUNKS, PATROL))
def patrol_sample(spark, sf):
    """Chunks that a patrol touches: the share of a day that has elapsed, rounded up by chance."""
    chains = files(spark, sf).select("db_id", "chain")
    wanted = R.desired_touches(F.col("n"), 3600.0 * (F.col("n") % 30), 86_400.0, (F.col("n") % 10) / F.lit(10.0))
    return U.patrol(_chunks(spark, sf).join(chains, "db_id").select("chain", "fp"), "chain", wanted, "patrol")


TARGET_JSON = '{"replication_targets":[{"s3":{"region":"r","chunk_bucket":"c%d","manifest_bucket":"m"}},{"local":{"directory":"/d%d","num_shards":10,"capacity":1000}},{"read_only":{"directory":"/ro"}},{"local":{"directory":"/second"}}]}'


@query("select event_id, pos::int as pos, kind, place, role from events, (values (0, 's3', null), (1, 'local', 'writer'), (2, 'read_only', 'reader'), (3, 'local', 'reader')) t(pos, kind, role), lateral (select case pos when 0 then 'c' || event_id when 1 then '/d' || event_id when 2 then '/ro' else '/second' end as place)")
def json_targets(spark, sf):
    """Target lists from their JSON, one row a target, and the cache tier that each is."""
    e = F.col("event_id").cast("string")
    text = F.replace(F.replace(F.lit(TARGET_JSON), F.lit("c%d"), F.concat(F.lit("c"), e)), F.lit("d%d"), F.concat(F.lit("d"), e))
    kind = lambda t: F.when(t["s3"].isNotNull(), "s3").when(t["local"].isNotNull(), "local").otherwise("read_only")
    lists = table(spark, sf, "events").select("event_id", F.from_json(text, TARGETS_SCHEMA)["replication_targets"].alias("ts"))
    # A list is one row, so its first local target is found there: no join or window over as many rows as there are targets.
    listed = lists.withColumn("first", F.array_position(F.transform("ts", kind), "local") - 1).select("event_id", "first", F.posexplode("ts").alias("pos", "t"))
    place = F.coalesce("t.s3.chunk_bucket", "t.local.directory", "t.read_only.directory").alias("place")
    return listed.select("event_id", "pos", kind(F.col("t")).alias("kind"), place, U.role(kind(F.col("t")), F.col("pos") == F.col("first")).alias("role"))


@query(
    "select n_nationkey, case n_nationkey % 5 when 0 then 'http://127.0.0.1:9000' when 1 then 'https://example.org/x' when 2 then 'https://r' || n_nationkey when 3 then 'https://s3.us-east-1.amazonaws.com' else 'https://s3.eu-west-3.amazonaws.com' end as endpoint, "
    "case n_nationkey % 5 when 0 then 'r' || n_nationkey || '.y' when 1 then 'mine' when 2 then 'r' || n_nationkey when 3 then 'us-east-1' else 'eu-west-3' end as region from nation"
)
def region_parse(spark, sf):
    """Regions with an endpoint, of the form name.endpoint, bare ones, and standard ones."""
    k = F.col("n_nationkey")
    bare = F.concat(F.lit("r"), k.cast("string"))
    region = F.when(k % 5 == 0, F.concat(bare, F.lit(".y"))).when(k % 5 == 1, "mine.example.org/x").when(k % 5 == 2, bare).when(k % 5 == 3, "us-east-1").otherwise("eu-west-3")
    given = F.when(k % 5 == 0, "http://127.0.0.1:9000")
    return table(spark, sf, "nation").select("n_nationkey", N.endpoint(region, given).alias("endpoint"), N.region_name(region, given).alias("region"))


@query("select event_id, user_id || '.' || lpad((event_id % 1000)::varchar, 9, '0') as at, user_id || '.' || case when event_id % 2 = 0 then '999999999' else '000000000' end as clamped from events")
def timestamps(spark, sf):
    far = F.when(F.col("event_id") % 2 == 0, F.lit(10**12)).otherwise(F.lit(-5))
    return table(spark, sf, "events").select("event_id", N.ns_timestamp(F.col("user_id"), F.col("event_id") % 1000).alias("at"), N.ns_timestamp(F.col("user_id"), far).alias("clamped"))


MANGLED = "replace(replace(replace(replace(replace(replace(p, '%', '%25'), '#', '%23'), chr(1), '%01'), 'é', '%C3%A9'), chr(127), '%7F'), '/', '#')"


@query(with_(f"select db_id, case when strlen(m) >= 230 then m[1:104] || md5(m) || m[-104:] else m end as name, case when strlen(m) < 230 then p end as again from (select db_id, p, {MANGLED} as m from (select db_id, path || ' +&' || chr(127) || repeat('/x#é%' || chr(1), db_id % 20) as p from files))", FILES))
def mangle_paths(spark, sf):
    path = F.concat("path", F.lit(" +&\x7f"), F.repeat(F.lit("/x#é%\x01"), (F.col("db_id") % 20).cast("int")))
    named = files(spark, sf).select("db_id", N.mangled(path).alias("name"))
    return named.withColumn("again", N.unmangled(F.col("name")))


# Streaming forms: each runs to the end of its input and returns what it wrote.


@query(with_("select distinct db_id, txn, chunk_index from dirty", LOG, DIRTY))
def stream_dirty(spark, sf):
    return jobs.stream_dirty(spark, f"{sf}/events.parquet", G)


@query(_throttle_sql("user_id, event_type", DAY))
def stream_throttle(spark, sf):
    return jobs.stream_throttle(spark, f"{sf}/events.parquet", DAY)


@query("select distinct user_id, event_type from events")
def stream_dedup(spark, sf):
    return jobs.stream_distinct(spark, f"{sf}/events.parquet", ["user_id", "event_type"])


def _late_sql() -> str:
    """Windows that are closed once all batches are in, of the events that came in time."""
    return "select day, event_type, count(*)::bigint as n from (select *, date_trunc('day', ts) as day from events where ts >= timestamp '2024-01-20' or event_id % 3 < 2) where day + interval 1 day <= (select max(ts) from events) - interval 1 day group by day, event_type"


@query(_late_sql())
def stream_late_events(spark, sf):
    """Daily counts in append mode over four files, of which the last holds events that the watermark has passed: they are dropped."""
    return jobs.stream_late(spark, f"{sf}/events.parquet").select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query(_throttle_sql("user_id, event_type", DAY))
def stream_throttle_batches(spark, sf):
    """The throttle over several files in order of time, its state carried from batch to batch."""
    return jobs.stream_throttle(spark, jobs.in_files(spark, f"{sf}/events.parquet", 4), DAY)


@query("select date_trunc('day', ts) as day, event_type, count(*)::bigint as n from events group by all")
def stream_tumbling(spark, sf):
    return jobs.stream_windows(spark, f"{sf}/events.parquet", "1 day").select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("select s as start, event_type, count(*)::bigint as n from (select *, unnest([date_trunc('day', ts) + to_hours(12 * (extract(hour from ts) // 12)::int), date_trunc('day', ts) + to_hours(12 * (extract(hour from ts) // 12)::int) - interval 12 hour]) as s from events) group by all")
def stream_sliding(spark, sf):
    return jobs.stream_windows(spark, f"{sf}/events.parquet", "1 day", "12 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("select user_id, min(ts) as start, count(*)::bigint as n from (select *, sum(new) over (partition by user_id order by ts, event_id) as session from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hour then 0 else 1 end as new from events)) group by user_id, session")
def stream_session(spark, sf):
    return jobs.stream_sessions(spark, f"{sf}/events.parquet", "6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("select user_id, max_by(event_id, (ts, event_id)) as event_id from events group by user_id")
def stream_snapshot(spark, sf):
    return jobs.stream_latest(spark, f"{sf}/events.parquet")
