"""Queries over chunks, manifests, snapshots and change tracking."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chunkvault.operators import chunks as C
from chunkvault.operators import manifests as M
from chunkvault.operators import snapshots as S
from chunkvault.operators import tracking as T
from chunkvault.plans.catalog import CHAIN, CHUNKS, FILES, LOG, SIGNED, G, files, query, table, with_, write_log
from chunkvault.storage import store


def _chunks(spark, sf, with_data=False):
    return C.chunk_scan(files(spark, sf), G, with_data)


@query(with_("select db_id, chunk_index, begin, size, fp from chunks", FILES, CHUNKS))
def chunk_scan(spark, sf):
    return _chunks(spark, sf)


@query(with_("select db_id, chunk_index, begin, size, fp from chunks", "files as (select page_id as db_id, '' as host, '' as chain, encode(html) as content from pages)", CHUNKS))
def chunk_scan_pages(spark, sf):
    return C.chunk_scan(table(spark, sf, "pages").select(F.col("page_id").alias("db_id"), F.encode("html", "utf-8").alias("content")), G)


@query(with_(f"select fp, {SIGNED.format(f='fp', a=1)} as major, {SIGNED.format(f='fp', a=17)} as minor, count(*)::bigint as uses from chunks group by fp", FILES, CHUNKS))
def fingerprint_words(spark, sf):
    major, minor = C.fingerprint_words(F.col("fp"))
    return _chunks(spark, sf).groupBy("fp").agg(F.count(F.lit(1)).alias("uses")).select("fp", major.alias("major"), minor.alias("minor"), "uses")


@query(with_("select db_id, case when octet_length(content) >= 100 then md5(unhex(substr(hex(content), 1, 200))) end as header_fp from files", FILES))
def header_fingerprint(spark, sf):
    return files(spark, sf).select("db_id", C.header_fingerprint(F.col("content")).alias("header_fp"))


@query(with_("select fp, min(size)::bigint as size, count(*)::bigint as uses from chunks group by fp", FILES, CHUNKS))
def chunk_dedup(spark, sf):
    return _chunks(spark, sf).groupBy("fp").agg(F.min("size").alias("size"), F.count(F.lit(1)).alias("uses"))


@query(with_("select distinct c.fp, c.size from chunks c where c.db_id % 2 = 1 and c.fp not in (select fp from chunks where db_id % 2 = 0)", FILES, CHUNKS))
def stage_new_chunks(spark, sf):
    scanned = _chunks(spark, sf)
    return C.new_chunks(scanned.where("db_id % 2 = 1"), scanned.where("db_id % 2 = 0"))


@query(with_("select host, sum(size)::bigint as total_bytes, sum(case when rn = 1 then size else 0 end)::bigint as unique_bytes, count(distinct fp)::bigint as unique_chunks from (select *, row_number() over (partition by host, fp order by db_id, chunk_index) as rn from chunks) group by host", FILES, CHUNKS))
def dedup_ratio(spark, sf):
    per_chunk = _chunks(spark, sf).join(files(spark, sf).select("db_id", "host"), "db_id").groupBy("host", "fp").agg(F.sum("size").alias("total"), F.min("size").alias("one"))
    return per_chunk.groupBy("host").agg(F.sum("total").alias("total_bytes"), F.sum("one").alias("unique_bytes"), F.count(F.lit(1)).alias("unique_chunks"))




ZEROED = f"zeroed as (select db_id, i as chunk_index, fp from (select db_id, chunk_index as i, fp from chunks union all select db_id, n + 1, md5(unhex(repeat('00', {G}))) from (select db_id, max(chunk_index) as n from chunks where db_id % 3 = 0 group by db_id)))"


@query(with_(f"select db_id, chunk_index, fp from zeroed where fp <> md5(unhex(repeat('00', {G})))", FILES, CHUNKS, ZEROED))
def well_known_filter(spark, sf):
    """All chunks but zero ones, of files of which every third has blocks of zeros at its end."""
    size = F.octet_length("content")
    padded = F.when((F.col("db_id") % 3 == 0) & (size > 0), F.concat("content", F.expr(f"unhex(repeat('00', cast(pmod(-octet_length(content), {G}) + {G} as int)))"))).otherwise(F.col("content"))
    scanned = C.chunk_scan(files(spark, sf).withColumn("content", padded), G).where(F.col("fp") != C.zero_fingerprint(G))
    # The last chunk of real bytes is filled up too; its own fingerprint is told.
    return scanned.join(_chunks(spark, sf).select("db_id", "chunk_index", F.col("fp").alias("own")), ["db_id", "chunk_index"]).select("db_id", "chunk_index", F.col("own").alias("fp"))


MANIFESTS = "manifests as (select f.db_id, octet_length(any_value(f.content))::bigint as len, count(c.fp)::bigint as n_chunks, case when octet_length(any_value(f.content)) >= 100 then md5(unhex(substr(hex(any_value(f.content)), 1, 200))) end as header_fp, md5(coalesce(string_agg(c.fp, '' order by c.chunk_index), '')) as contents_fp from files f left join chunks c on f.db_id = c.db_id group by f.db_id)"


@query(with_("select * from manifests", FILES, CHUNKS, MANIFESTS))
def manifest_build(spark, sf):
    return M.build_manifests(files(spark, sf), G)


@query(with_("select db_id, len, n_chunks, contents_fp from manifests where n_chunks > 0", FILES, CHUNKS, MANIFESTS))
def manifest_from_chunks(spark, sf):
    return M.manifest_from_chunks(_chunks(spark, sf)).select("db_id", "len", "n_chunks", "contents_fp")


@query(with_("select db_id, n_chunks, len, contents_fp, true as restored_ok from manifests", FILES, CHUNKS, MANIFESTS))
def restore_verify(spark, sf):
    return M.scan_and_check(files(spark, sf), G)


@query(with_("select db_id, sum(size)::bigint as got, any_value(want)::bigint as want, sum(size) = any_value(want) as valid from (select c.db_id, c.size, octet_length(f.content) + case when f.db_id % 7 = 0 then 1 else 0 end as want from chunks c join files f using (db_id)) group by db_id", FILES, CHUNKS))
def length_validation(spark, sf):
    want = files(spark, sf).select("db_id", (F.octet_length("content") + F.when(F.col("db_id") % 7 == 0, 1).otherwise(0)).cast("long").alias("want"))
    got = _chunks(spark, sf).groupBy("db_id").agg(F.sum("size").alias("got"))
    return got.join(want, "db_id").select("db_id", "got", "want", (F.col("got") == F.col("want")).alias("valid"))


@query(with_("select db_id, chunk_index, (\"end\" - size)::bigint as begin, \"end\"::bigint as \"end\" from (select db_id, chunk_index, size, sum(size) over (partition by db_id order by chunk_index) as \"end\" from chunks)", FILES, CHUNKS))
def interval_map(spark, sf):
    return S.intervals(_chunks(spark, sf)).select("db_id", "chunk_index", "begin", "end")


def _probes(spark, sf):
    return files(spark, sf).select(F.col("db_id").alias("probe_id"), "db_id", ((F.col("db_id") * 7919) % (3 * G)).alias("offset"), ((F.col("db_id") * 104729) % (2 * G)).alias("length"))


@query(with_(f"select db_id as probe_id, db_id, octet_length(piece)::bigint as n, hex(piece) as bytes_hex from (select db_id, unhex(substr(hex(content), 2 * ((db_id * 7919) % {3 * G}) + 1, 2 * ((db_id * 104729) % {2 * G}))) as piece from files)", FILES))
def range_read(spark, sf):
    return S.range_read(_chunks(spark, sf, True), _probes(spark, sf), G)


EDGES = "edges as (select db_id * 10 + k as probe_id, db_id, case k when 0 then n when 1 then n + 1 when 2 then n - 1 when 3 then 0 else 9223372036854775807 end as off, case k when 0 then 1 when 1 then 9223372036854775807 when 2 then 9223372036854775807 when 3 then 0 else 9223372036854775807 end as len, n, content from (select *, octet_length(content)::bigint as n from files where octet_length(content) > 0), unnest(range(5)) as t(k))"


@query(with_("select probe_id, db_id, octet_length(piece)::bigint as n, hex(piece) as bytes_hex from (select probe_id, db_id, case when off >= n or len = 0 then unhex('') else unhex(substr(hex(content), 2 * off + 1, 2 * least(len, n - off))) end as piece from edges)", FILES, EDGES))
def range_read_boundaries(spark, sf):
    most = 9223372036854775807
    n = F.octet_length("content").cast("long")
    probes = files(spark, sf).where(F.octet_length("content") > 0).select("db_id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    off = F.when(F.col("k") == 0, F.col("n")).when(F.col("k") == 1, F.col("n") + 1).when(F.col("k") == 2, F.col("n") - 1).when(F.col("k") == 3, 0).otherwise(F.lit(most))
    length = F.when(F.col("k") == 0, 1).when(F.col("k") == 3, 0).otherwise(F.lit(most)).cast("long")
    return S.range_read(_chunks(spark, sf, True), probes.select((F.col("db_id") * 10 + F.col("k")).alias("probe_id"), "db_id", off.cast("long").alias("offset"), length.alias("length")), G)


@query(with_("select db_id, chunk_index, fp from (select *, count(*) over (partition by db_id) as n from chunks) where chunk_index < least(greatest(ceil(sqrt(n)), greatest(1, least(1, n))), greatest(3, greatest(1, least(1, n)))) or chunk_index = n - 1", FILES, CHUNKS))
def partial_load(spark, sf):
    return S.partial_load(_chunks(spark, sf), 1, 3).select("db_id", "chunk_index", "fp")


@query(with_("select w.fp, case when exists (select 1 from chunks a where a.fp = w.fp and a.db_id % 3 = 0) then 0 when exists (select 1 from chunks b where b.fp = w.fp and b.db_id in (select doc_id from labels)) then 1 end as tier from (select distinct fp from chunks) w", FILES, CHUNKS))
def tiered_lookup(spark, sf):
    scanned = _chunks(spark, sf)
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("db_id")).distinct()
    return S.fetch(scanned, [scanned.where("db_id % 3 = 0"), scanned.join(labelled, "db_id", "left_semi")])


@query(with_("select distinct c.fp from chunks c where c.fp not in (select fp from chunks where db_id % 5 <> 0)", FILES, CHUNKS))
def missing_chunks(spark, sf):
    scanned = _chunks(spark, sf)
    return S.fetch(scanned, [scanned.where("db_id % 5 <> 0")]).where("tier is null").select("fp")


DIRTY = f"dirty as (select db_id, txn, seq, i as chunk_index from log, unnest(range(\"offset\" // {G}, (\"offset\" + \"count\" - 1) // {G} + 1)) as t(i))"


@query(with_("select * from dirty", LOG, DIRTY))
def dirty_expand(spark, sf):
    return T.dirty_chunks(write_log(spark, sf), G).select("db_id", "txn", "seq", "chunk_index")


@query(with_("select db_id, txn, string_agg(distinct chunk_index::varchar, ',' order by chunk_index::varchar) as dirty, count(distinct chunk_index)::bigint as n from dirty group by db_id, txn", LOG, DIRTY))
def dirty_set_per_txn(spark, sf):
    touched = T.dirty_chunks(write_log(spark, sf), G)
    return touched.groupBy("db_id", "txn").agg(F.array_join(F.array_sort(F.collect_set(F.col("chunk_index").cast("string"))), ",").alias("dirty"), F.count_distinct("chunk_index").alias("n"))


SIZES = "sizes as (select db_id, coalesce(octet_length(prev_content), 0)::bigint as old_len, octet_length(content)::bigint as new_len, prev_id, content, prev_content from chain_files)"



@query(with_(f"select db_id, i as chunk_index from sizes, unnest(range(least(old_len, new_len) // {G}, case when old_len = new_len then least(old_len, new_len) // {G} else (greatest(old_len, new_len) - 1) // {G} + 1 end)) as t(i)", FILES, CHAIN, SIZES))
def truncate_dirty(spark, sf):
    sizes = M.beside_previous(files(spark, sf), F.octet_length("content").cast("long"), "len")
    return sizes.select("db_id", F.explode(T.truncated(F.coalesce("prev_len", F.lit(0).cast("long")), F.col("len"), G)).alias("chunk_index"))


OLD_NEW = "old_new as (select n.db_id, o.chunk_index, o.fp from chain_files n join chunks o on n.prev_id = o.db_id)"
DIFF = "diff as (select coalesce(n.db_id, o.db_id) as db_id, coalesce(n.chunk_index, o.chunk_index) as chunk_index, case when o.fp is null then 'added' when n.fp is null then 'removed' when n.fp = o.fp then 'same' else 'changed' end as change from chunks n full outer join old_new o on n.db_id = o.db_id and n.chunk_index = o.chunk_index)"


def _old_new(spark, sf, scanned=None):
    scanned = _chunks(spark, sf).select("db_id", "chunk_index", "fp") if scanned is None else scanned
    ids = M.chain(files(spark, sf)).select("db_id", "prev_id")
    return ids.join(scanned.withColumnRenamed("db_id", "prev_id"), "prev_id").select("db_id", "chunk_index", "fp"), scanned


@query(with_("select * from diff", FILES, CHUNKS, CHAIN, OLD_NEW, DIFF))
def manifest_diff(spark, sf):
    old, new = _old_new(spark, sf)
    return T.manifest_diff(old, new, ["db_id"])


COUNTS = f"counts as (select db_id, (octet_length(content) + {G - 1}) // {G} as n, case when prev_id is not null then (octet_length(prev_content) + {G - 1}) // {G} end as p from chain_files)"
BACKFILL = "case when p is null then 0 else greatest(least(p, n) - case when p < n then 1 else 0 end, 0) end"



@query(with_(f"select db_id, n::bigint as n, p::bigint as p, ({BACKFILL})::bigint as backfill from counts", FILES, CHAIN, COUNTS))
def backfill_start(spark, sf):
    counts = M.beside_previous(files(spark, sf), C.chunk_count(F.octet_length("content"), G), "n")
    return counts.select("db_id", "n", F.col("prev_n").alias("p"), T.backfill_start(F.col("prev_n"), F.col("n"), F.lit(False)).alias("backfill"))


@query(with_("select db_id, count(*)::bigint as chunks, md5(string_agg(fp, '' order by chunk_index)) as contents_fp, true as equals_full from chunks group by db_id", FILES, CHUNKS))
def incremental_equals_full(spark, sf):
    """Snapshots from the previous version, its dirty chunks and the backfill; compared with a full scan. Files are cut once, and their lists stored."""
    old, new = _old_new(spark, sf, store(_chunks(spark, sf).select("db_id", "chunk_index", "fp"), "chunk-lists"))
    dirty = T.manifest_diff(old, new, ["db_id"]).where("change <> 'same'")
    sizes = backfill_start(spark, sf).select("db_id", "n", "backfill")
    made = T.incremental(old, new, sizes, dirty).groupBy("db_id").agg(F.count(F.lit(1)).alias("chunks"), C.list_fingerprint(F.col("chunk_index"), F.col("fp")).alias("contents_fp"))
    full = new.groupBy("db_id").agg(C.list_fingerprint(F.col("chunk_index"), F.col("fp")).alias("full_fp"))
    return made.join(full, "db_id", "full_outer").select("db_id", "chunks", "contents_fp", (F.col("contents_fp") == F.col("full_fp")).alias("equals_full"))


VERSIONS = "versions as (select event_id, event_type <> 'view' as dirty, event_id % 3 > 0 as any_dirty, case event_id % 4 when 0 then '' when 1 then 'a' when 2 then 'b' else 'c' end as prev, case event_id % 5 when 0 then '' when 1 then 'a' when 2 then 'b' else 'd' end as cur, case event_id % 7 when 0 then null when 1 then '' when 2 then 'a' when 3 then 'b' when 4 then 'c' else 'd' end as m from events)"


@query(with_("select event_id, case when dirty then case when m is null or prev = '' or cur = '' or prev = cur or not any_dirty then 'desync' when m = prev or m = cur then 'initial' else 'desync' end when cur <> '' and m is not null and m = cur then 'up_to_date' else 'desync' end as verdict from versions", VERSIONS))
def judge_manifest(spark, sf):
    e = F.col("event_id")
    pick = lambda base, *names: F.element_at(F.array(*[F.lit(n) for n in names]), (e % base + 1).cast("int"))
    rows = table(spark, sf, "events").select("event_id", (F.col("event_type") != "view").alias("dirty"), (e % 3 > 0).alias("some"), pick(4, "", "a", "b", "c").alias("p"), pick(5, "", "a", "b", "d", "d").alias("c"), pick(7, None, "", "a", "b", "c", "d", "d").alias("m"))
    return rows.select("event_id", T.judge(F.col("dirty"), F.col("some"), F.col("p"), F.col("c"), F.col("m")).alias("verdict"))


WORDS = f"words as (select c.db_id, list(w order by c.chunk_index, h) as own from (select db_id, chunk_index, 0 as h, {SIGNED.format(f='fp', a=1)} as w from chunks union all select db_id, chunk_index, 1, {SIGNED.format(f='fp', a=17)} from chunks) c group by c.db_id)"
XORED = "xored as (select f.db_id, o.own, b.own as base, list_transform(range(len(o.own)), lambda i: xor(o.own[i + 1], coalesce(b.own[i + 1], 0))) as coded from chain_files f join words o on f.db_id = o.db_id left join words b on f.prev_id = b.db_id)"


def _xored(spark, sf):
    lists = M.beside_previous(files(spark, sf), M.words(F.col("content"), G), "own").where(F.size("own") > 0)
    return lists.select("db_id", "own", F.col("prev_own").alias("base")).withColumn("coded", M.xor_base(F.col("own"), F.col("base")))


@query(with_("select db_id, array_to_string(coded, ',') as coded from xored", FILES, CHUNKS, CHAIN, WORDS, XORED))
def xor_base_encode(spark, sf):
    return _xored(spark, sf).select("db_id", F.array_join(F.col("coded").cast("array<string>"), ",").alias("coded"))


@query(with_("select db_id, array_to_string(own, ',') as own, true as same from xored", FILES, CHUNKS, CHAIN, WORDS, XORED))
def xor_roundtrip(spark, sf):
    back = M.xor_base(F.col("coded"), F.col("base"))
    return _xored(spark, sf).select("db_id", F.array_join(back.cast("array<string>"), ",").alias("own"), (back == F.col("own")).alias("same"))


@query(with_("select db_id, matches::bigint as matches, len(own)::bigint as total, case when db_id % 3 < matches then 'reuse' when len(own) < 600 then 'none' else 'refresh' end as action from (select *, len(list_filter(coded, lambda x: x = 0)) as matches from xored)", FILES, CHUNKS, CHAIN, WORDS, XORED))
def base_chunk_action(spark, sf):
    counted = _xored(spark, sf).select("db_id", F.size(F.filter("coded", lambda x: x == 0)).cast("long").alias("matches"), F.size("own").cast("long").alias("total"))
    return counted.withColumn("action", M.base_action(F.col("matches"), F.col("total"), F.col("db_id") % 3))


@query(with_("select db_id, chunk_index, size, hex(data) as data_hex from chunks where begin = 0", FILES, CHUNKS))
def bundle_chunks(spark, sf):
    return _chunks(spark, sf, True).where(F.col("begin").isin(0)).select("db_id", "chunk_index", "size", F.hex("data").alias("data_hex"))


@query(with_("select db_id, chunk_index, case when chunk_index = 0 then md5(data) when db_id % 2 = 0 then md5(data) end as got from chunks", FILES, CHUNKS))
def bundle_substitute(spark, sf):
    scanned = _chunks(spark, sf, True)
    bundled = scanned.where("chunk_index = 0")
    fetched = scanned.withColumn("data", F.when((F.col("chunk_index") > 0) & (F.col("db_id") % 2 == 0), F.col("data")))
    return M.substitute_bundled(fetched, bundled).select("db_id", "chunk_index", F.md5("data").alias("got"))


@query(with_("select db_id, chunk_index, case when chunk_index = 0 then repeat('0', 32) else fp end as fp from chunks", FILES, CHUNKS))
def zero_bundled_fps(spark, sf):
    return _chunks(spark, sf).select("db_id", "chunk_index", F.when(F.col("chunk_index") == 0, F.repeat(F.lit("0"), 32)).otherwise(F.col("fp")).alias("fp"))


@query("select event_id, v is not null and prev is not null and v <> '' and v = prev as based_on_prev from (select event_id, v, lag(v) over (partition by user_id order by ts, event_id) as prev from (select *, case when event_id % 3 = 0 then '' else event_type end as v from events))")
def version_match(spark, sf):
    v = F.nullif(F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")), F.lit(""))
    before = F.lag("v").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf, "events").withColumn("v", v).withColumn("prev", before).select("event_id", F.coalesce(F.col("v") == F.col("prev"), F.lit(False)).alias("based_on_prev"))


@query(with_("select f.chain, f.db_id, md5(content) as contents_fp from files f where f.db_id = (select max(g.db_id) from files g where g.chain = f.chain)", FILES))
def latest_manifest(spark, sf):
    return M.latest(files(spark, sf).select("chain", "db_id", F.md5("content").alias("contents_fp")), ["chain"], ["db_id"])


@query("select p.event_id, m.event_id as manifest_id from (select * from events where event_type = 'view') p asof left join (select user_id, ts, max(event_id) as event_id from events where event_type = 'purchase' group by user_id, ts) m on p.user_id = m.user_id and p.ts >= m.ts")
def asof_manifest(spark, sf):
    events = table(spark, sf, "events")
    made = events.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("made")).agg(F.max("event_id").alias("manifest_id"))
    probes = events.where("event_type = 'view'").select("user_id", "event_id", "ts")
    return M.as_of(made, probes, "user_id", "ts", "made").select("event_id", "manifest_id")


@query(with_("select db_id, substr(hex(content), 1, 16) = 'D9D505F920A163D7' as hot from (select db_id, case when db_id % 4 = 0 then unhex('D9D505F920A163D7' || hex(content)) else content end as content from files)", FILES))
def hot_journal(spark, sf):
    magic = F.unhex(F.lit("D9D505F920A163D7"))
    data = F.when(F.col("db_id") % 4 == 0, F.concat(magic, F.col("content"))).otherwise(F.col("content"))
    return files(spark, sf).select("db_id", (F.substring(data, 1, 8) == magic).alias("hot"))


@query(with_("select db_id, coalesce(header, '') || '|' || case when db_id % 5 = 0 then '' else db_id::varchar end as version_id, nullif(case when db_id % 5 = 0 then '' else coalesce(header, '') end, '') is not null as trusted from (select db_id, case when octet_length(content) >= 100 then md5(unhex(substr(hex(content), 1, 200))) end as header from files)", FILES))
def version_id(spark, sf):
    header = C.header_fingerprint(F.col("content"))
    mark = F.when(F.col("db_id") % 5 == 0, "").otherwise(F.col("db_id").cast("string"))
    trusted = F.nullif(F.when(F.col("db_id") % 5 == 0, "").otherwise(F.coalesce(header, F.lit(""))), F.lit("")).isNotNull()
    return files(spark, sf).select("db_id", F.concat(F.coalesce(header, F.lit("")), F.lit("|"), mark).alias("version_id"), trusted.alias("trusted"))
