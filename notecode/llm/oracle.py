"""The queries of this package in the SQL of DuckDB, where SQL can say them."""

_COMPONENTS = """
reach as (select a as node, a as root from nodes
          union select r.node, l.b from reach r join links l on l.a = r.root),
least as (select node, min(root) as component_id from reach group by node)"""

_WARC = """
with pages_ as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as digest from pages),
kept as (select digest, max(page_id) as keep from pages_ where n >= 1000 group by digest)
select page_id, n as payload_bytes, digest as payload_digest,
  case when keep <> page_id then 'revisit' else 'response' end as record_type,
  case when keep <> page_id then keep end as refers_to,
  case when keep <> page_id then null else true end as digest_ok
from pages_ left join kept using (digest)"""

_VECTORS = f"""
with recursive links as (
  select x.vec_id as a, y.vec_id as b from embeddings x join embeddings y on x.label = y.label and x.vec_id <> y.vec_id
  where list_cosine_similarity(x.embedding::double[], y.embedding::double[]) >= 0.93),
nodes as (select vec_id as a from embeddings),{_COMPONENTS},
counts as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings join least on node = vec_id left join counts on a = vec_id"""

_JACCARD = f"""
with recursive worded as (
  select doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
    lambda w: w <> '') as w from documents),
shingled as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from worded),
single as (select doc_id, len(s) as n, unnest(s) as x from shingled),
links as (
  select p.doc_id as a, q.doc_id as b from single p join single q on p.x = q.x and p.doc_id <> q.doc_id
  group by p.doc_id, q.doc_id, p.n, q.n having 100 * count(*) >= 80 * (p.n + q.n - count(*))),
nodes as (select doc_id as a from documents),{_COMPONENTS}
select doc_id, len(s) as n_shingles, component_id from shingled join least on node = doc_id"""

_MIX = """
with sized as (
  select doc_id, source, text is not null and text <> '' as filled,
    case when text is null then 0
      else len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) end as size,
    md5(md5(coalesce(cast(doc_id as varchar), '')) || md5(coalesce(text, ''))) as key, row_number() over () as r
  from documents),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select *, [5.0::double, 2.0::double, 1.0::double][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
  from sources),
levels as (
  select *, (sum(source_size) over () - 3 * coalesce(sum(source_size) over (o rows between unbounded preceding and 1 preceding), 0))::double
    / sum(weight) over (o rows between current row and unbounded following) as level
  from weighed window o as (order by source_size / weight, source nulls last)),
targets as (
  select source, source_size,
    least(coalesce(max(case when level * weight <= 3 * source_size then level end) over (), 0.0) * weight, 3.0 * source_size)::double as target
  from levels),
queues as (
  select *, sum(size) over (partition by source order by key, r rows unbounded preceding)::bigint as total
  from sized where size > 0),
laps as (
  select q.source, q.key, q.r, q.size, (lap * source_size + total)::double / target as finish
  from queues q join targets t on q.source is not distinct from t.source cross join range(0, 3) as r(lap) where target > 0),
merged as (
  select *, sum(size) over (order by finish, source nulls first, key, r rows unbounded preceding) as reached from laps),
taken as (select r, count(*) as n from merged where reached <= (select sum(size) from sized) group by r)
select s.doc_id, s.size::bigint as size, t.source_size, t.target, (s.size * coalesce(n, 0))::bigint as taken
from sized s join targets t on s.source is not distinct from t.source
left join taken k using (r)"""

_TRIE = """
with keyed as (
  select conv_id, turn, length(coalesce(text, '')) as chars,
    left(sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')), 32) as key
  from conversations where conv_id is not null),
own as (
  select conv_id, conv_id::varchar as name, list({'key': key, 'chars': chars} order by turn nulls first, key) as s
  from keyed group by conv_id),
hashed as (
  select conv_id, s, xor(list_reduce(
      list_prepend(4294967295::bigint, list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::bigint)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
        lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % 6 as h
  from own),
whole as (
  select a.conv_id, list_concat(coalesce(b.s[1:a.h], []), a.s[a.h + 1:]) as s
  from hashed a left join hashed b on b.conv_id = a.conv_id - a.conv_id % 100),
prefixes as (
  select conv_id, d, sha256(array_to_string(list_transform(s[1:d], lambda x: x.key), ',')) as p,
    case when d > 0 then s[d].chars else 0 end as chars, len(s) = d as ended
  from (select conv_id, s, unnest(range(0, len(s) + 1)) as d from whole)),
nodes as (
  select p, d, min(conv_id) as c, count(*) as n, min(chars) as chars,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ended), '')) as ends_sha256
  from prefixes group by p, d),
parents as (select n.p, q.p as parent from nodes n join prefixes q on q.conv_id = n.c and q.d = n.d - 1),
kids as (select parent, count(*) as k from parents group by parent),
owned as (
  select n.*, coalesce(k, 0) as k, case when k is null then 1 else 0 end as leaf, (n - 1) * chars as saved
  from nodes n left join kids on parent = p),
below as (
  select q.p, sum(leaf) as leaves, sum(saved) as saved
  from owned o join prefixes q on q.conv_id = o.c and q.d <= o.d group by q.p)
select o.c as conv_id, o.d as depth, m.c as parent_conv_id, o.n as n_convs, o.k as n_children,
  b.leaves::bigint as n_leaves, b.saved::bigint as saved_tokens, o.ends_sha256
from owned o join below b on b.p = o.p left join parents r on r.p = o.p left join nodes m on m.p = r.parent"""


def _nearest(book: str) -> str:
    """The nearest entry of a book for every part of every vector, as (`e.d`, `e.entry`)."""
    return f"""(
  select r, part, min({{'d': d, 'entry': entry}}) as e from (
    select r, part, entry, sum((x - y) * (x - y))::bigint as d from comps join {book} using (part, pos)
    group by r, part, entry) group by r, part)"""


def _moved(book: str) -> str:
    """The book after a round: its entries moved to the middle of what they own."""
    return f"""(
  select part, entry, pos, coalesce(z, y) as y from {book} left join (
    select part, e.entry as entry, pos, floor(sum(x)::double / count(*))::bigint as z
    from {_nearest(book)} join comps using (r, part) group by all) using (part, entry, pos))"""


_CODES = f"""
with kept as (
  select row_number() over (order by vec_id nulls last, embedding) as r, vec_id, label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
comps as (
  select r, i // (n // 16) as part, i % (n // 16) as pos, v[i + 1] as x
  from (select r, v, len(v) as n, unnest(range(0, len(v))) as i from kept)),
book0 as (select part, r - 1 as entry, pos, x as y from comps where r <= 64),
book1 as {_moved("book0")},
book2 as {_moved("book1")},
coded as (
  select r, string_agg(printf('%02x', e.entry::integer), '' order by part) as code, sum(e.d)::bigint as error
  from {_nearest("book2")} group by r),
digest as (select sha256(string_agg(y::varchar, ',' order by part, entry, pos)) as codebooks_sha256 from book2)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from kept join coded using (r) cross join digest"""

LLM_ORACLE: dict[str, str] = {
    "op3_warc_chunks": _WARC,
    "op5_grid_order": _VECTORS,
    "op6_jaccard_regions": _JACCARD,
    "op7_fair_mix": _MIX,
    "op11_prefix_trie": _TRIE,
    "op12_part_codes": _CODES,
}
