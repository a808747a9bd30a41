"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from chunkvault.llm.mixing import ROUNDS

LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"


def _moved(x: str, n: str, tag: str, back: bool = False) -> str:
    """x moved by the swap-or-not permutation that tag keys."""
    rounds = f"range({ROUNDS}, 0, -1)" if back else f"range(1, {ROUNDS + 1})"
    other = f"((('0x' || substr(md5({tag} || '|' || i), 1, 12))::bigint - x) % {n} + {n}) % {n}"
    return f"list_reduce({rounds}, lambda x, i: case when substr(md5({tag} || '|' || i || '|' || greatest(x, {other})), 1, 1) >= '8' then {other} else x end, ({x})::bigint)"


MIX = f"""
with sized as (select doc_id, source, len({WORDS.format(t="coalesce(text, '')")})::bigint as size from documents),
sources as (select source, sum(size)::bigint as total, row_number() over (order by source nulls last) - 1 as src from sized group by source),
weighed as (select *, (src % 3 + 1)::double as weight, 3.0::double * total as cap, sum(total) over ()::double as whole, sum(src % 3 + 1) over ()::double as weights from sources),
rated as (select *, (whole - coalesce(sum(cap) over w, 0)) / (weights - coalesce(sum(weight) over w, 0)) as rate, row_number() over (order by total / weight, src) as nth
 from weighed window w as (order by total / weight, src rows between unbounded preceding and 1 preceding)),
chosen as (select coalesce((select rate from rated where cap >= rate * weight order by nth limit 1), 0) as rate),
plan as (select r.src, r.source, total, least(cap, c.rate * weight) as target, least(round(least(cap, c.rate * weight))::bigint, floor(cap)::bigint) as take, ceil(total / 1024.0)::bigint as blocks from rated r, chosen c),
layout as (select *, case when total > 0 then take // total else 0 end as passes, case when total > 0 then take % total else 0 end as rest, total - (blocks - 1) * 1024 as short from plan),
blocks as (select src, passes, rest, b, case when b = l.blocks - 1 then short else 1024 end as words, {_moved("b", "l.blocks", "'17|' || src || '|' || passes", back=True)} as pos from layout l, unnest(range(l.blocks)) as t(b)),
used as (select *, greatest(least(rest - coalesce(sum(words) over (partition by src order by pos rows between unbounded preceding and 1 preceding), 0), words), 0) as more from blocks),
placed as (select doc_id, src, size, coalesce(sum(size) over (partition by src order by md5(coalesce(doc_id::varchar, '')), doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as a from sized join sources on sized.source is not distinct from sources.source),
cut as (select p.*, b from placed p, unnest(case when size > 0 then range(a // 1024, (a + size - 1) // 1024 + 1) else [] end) as t(b)),
parts as (select c.doc_id, c.src, c.a, greatest(c.a - c.b * 1024, 0) as x, least(c.a + c.size - c.b * 1024, 1024) as y, u.passes, u.more from cut c join used u on c.src = u.src and c.b = u.b),
taken as (select doc_id, src, a, sum((y - x) * passes + greatest(least(y, more) - x, 0))::bigint as taken from parts group by all)
select p.doc_id, p.size, l.total as source_size, l.target, coalesce(t.taken, 0)::bigint as taken from placed p join layout l on p.src = l.src left join taken t on p.src = t.src and p.a = t.a and p.size > 0 and p.doc_id is not distinct from t.doc_id
"""

LINES = f"""
with lines as (select doc_id, i, x[i] as line, trim({LOWER.format(t="x[i]")}, {SPACES}) as key from (select doc_id, string_split(coalesce(text, ''), chr(10)) as x from documents), unnest(range(1, len(x) + 1)) as t(i)),
firsts as (select key, min(doc_id) as first, count(distinct doc_id) as docs from lines where length(key) >= 10 group by key),
marked as (select l.*, coalesce(f.docs > 1 and f.first <> l.doc_id, false) as gone from lines l left join firsts f on l.key = f.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256 from marked group by doc_id
"""

NEAR = f"""
with recursive words as (select doc_id, {WORDS.format(t=LOWER.format(t="coalesce(text, '')"))} as w from documents),
shingles as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from words, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) as t(i)),
sizes as (select doc_id, count(*)::bigint as n from shingles group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
both_ways as (select a, b from links union select b, a from links),
reached as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reached r join both_ways l on r.b = l.a)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, r.component_id, d.doc_id = r.component_id as kept from documents d left join sizes using (doc_id) join (select a, min(b) as component_id from reached group by a) r on r.a = d.doc_id
"""

TOP = """
with whole as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, r.vec_id, list_inner_product(q.v, r.v)::bigint as score from whole q join whole r on q.vec_id <> r.vec_id and len(q.v) = len(r.v) where q.vec_id % 100 = 0),
ranked as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from scored)
select * from ranked where rank <= 10
"""

REPEATS = """
with bytes as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
pieces as materialized (select doc_id, 512 * k as o, substr(h, 1024 * k + 1, 1222) as c from bytes, unnest(range((length(h) // 2 + 511) // 512)) as t(k)),
windows as materialized (select doc_id, o + j as p, md5_number(substr(c, 2 * j + 1, 200)) as m from pieces, unnest(range(least(512, greatest(length(c) // 2 - 99, 0)))) as t(j)),
firsts as (select m, min(doc_id::hugeint * 1000000000 + p) as first from windows group by m having count(*) > 1),
repeated as (select doc_id, p from windows join firsts using (m) where doc_id::hugeint * 1000000000 + p > first),
starts as (select doc_id, p, p > coalesce(lag(p) over (partition by doc_id order by p) + 100, -1) as new from repeated),
spans as (select doc_id, min(p) as a, max(p) + 100 as b from (select *, sum(new::int) over (partition by doc_id order by p) as g from starts) group by doc_id, g),
gaps as (select doc_id, coalesce(lag(b) over w, 0) as a, a as b from spans window w as (partition by doc_id order by a) union all select doc_id, max(b), 1000000000 from spans group by doc_id),
kept as (select g.doc_id, string_agg(substr(h, 2 * g.a + 1, 2 * (g.b - g.a)), '' order by g.a) as rest from gaps g join bytes using (doc_id) group by g.doc_id),
counts as (select doc_id, count(*) as n_spans, sum(b - a) as n_removed from spans group by doc_id)
select b.doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(rest, h))) as kept_sha256 from bytes b left join kept using (doc_id) left join counts using (doc_id)
"""

SQL = {"op2_mix_sources": MIX, "op5_line_dedup": LINES, "op6_near_duplicates": NEAR, "op7_threshold_top_k": TOP, "op10_suffix_dedup": REPEATS}
