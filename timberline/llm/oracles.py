"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

import string

LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

#: Smallest id in reach: labels move along the links until none changes.
COMPONENTS = """reach as (select id, id as other from nodes union select r.id, l.b from reach r join links l on r.other = l.a),
labels as (select id, min(other) as component_id from reach group by id)"""

METRIC_JOIN = f"""
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings),
valid as (select vec_id, e from v where e is not null and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from valid a join valid b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.9),
nodes as (select vec_id as id from v), {COMPONENTS},
n as (select a, count(*) as n_links from links group by a)
select v.vec_id, coalesce(n_links, 0) as n_links, component_id, v.vec_id = component_id as kept from v join labels on v.vec_id = labels.id left join n on v.vec_id = n.a
"""

DECONTAMINATION = rf"""
with d as (select doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(10, len(w)) as n, array_to_string(list_slice(w, s, s + least(10, len(w)) - 1), ' ') as win from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s from b where len(w) > 0) x),
sizes as (select distinct n from bw),
dw as (select doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') as win from (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as s from d cross join sizes where len(w) >= n) x),
hits as (select doc_id, dw.n, s, item_id from dw join bw on dw.n = bw.n and dw.win = bw.win),
places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from hits) x group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as names from (select distinct doc_id, cast(item_id as varchar) as i from hits) x group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places p on d.doc_id = p.doc_id left join items i on d.doc_id = i.doc_id
"""

NEAR_DUPLICATES = rf"""
with recursive d as (select doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, k, k + least(5, len(w)) - 1), ' ') as g from (select doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) as k from d where len(w) > 0) x),
size as (select doc_id, count(*) as n from s group by doc_id),
shared as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by all),
links as (select a, b from shared join size p on a = p.doc_id join size q on b = q.doc_id where 100 * c >= 75 * (p.n + q.n - c)),
nodes as (select doc_id as id from d), {COMPONENTS}
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept from d join labels on d.doc_id = labels.id left join size on d.doc_id = size.doc_id
"""

#: Windows are cut from blocks of each text, since a long string is searched from its front for every piece.
REPEATS = """
with d as (select doc_id, row_number() over () as k, hex(encode(coalesce(text, ''))) as h from documents),
texts as (select h, min(k) as k, count(*) as copies from d group by h),
blocks as (select k, copies, b, substr(h, 2*b + 1, 1310) as part from (select k, copies, h, unnest(range(0, len(h)//2 - 399, 256)) as b from texts where len(h) >= 800) x),
w as (select k, copies, b + s as s, md5_number(substr(part, 2*s + 1, 800)) as name from (select k, copies, b, part, unnest(range(0, len(part)//2 - 399)) as s from blocks) x),
again as (select name from w group by name having sum(copies) > 1),
hits as (select k, s from w semi join again on w.name = again.name),
runs as (select k, min(s) as a, max(s) + 400 as b from (select k, s, sum(fresh) over (partition by k order by s) as run from (select k, s, case when s <= lag(s) over (partition by k order by s) + 400 then 0 else 1 end as fresh from hits) x) y group by k, run),
gone as (select k, count(*) as n, sum(b - a) as size, list(a order by a) as starts, list(b order by a) as ends from runs group by k),
kept as (select t.h, t.k, coalesce(g.n, 0) as n_spans, coalesce(g.size, 0) as n_removed, case when n is null then t.h else array_to_string(list_transform(range(0, n + 1), lambda j: substr(t.h, 2*(case when j = 0 then 0 else ends[j] end) + 1, 2*((case when j = n then len(t.h)//2 else starts[j+1] end) - (case when j = 0 then 0 else ends[j] end)))), '') end as left_over from texts t left join gone g on t.k = g.k)
select doc_id, cast(len(d.h)//2 as bigint) as n_bytes, cast(n_removed as bigint) as n_removed, cast(n_spans as bigint) as n_spans, sha256(unhex(left_over)) as kept_sha256 from d join kept on d.h = kept.h
"""

_REST = "case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end"
URL_RULES = rf"""
with p as (select page_id, coalesce({_REST}, '') as rest from pages),
parts as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
rules(h, b, verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits as (select page_id, h || b as rule, verdict, row_number() over (partition by page_id order by length(h || b) desc) as k from parts join rules on (host = h or suffix(host, '.' || h)) and prefix(path, b))
select parts.page_id, host, path, rule, verdict as rule_verdict from parts left join fits on parts.page_id = fits.page_id and k = 1
"""

SHARD_LAW = "select count(*) as n_rows, cast(sum(coalesce(octet_length(encode(text)), 0) + 1) as bigint) as n_bytes, true as gapless, true as even from documents"
