"""SQL for the queries of this folder that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op7_decontaminate"] = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), bw as (
  select distinct item_id, least(13, len(w)) as k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)
), dw as (
  select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as win
  from (select doc_id, w, k, unnest(range(1, cast(len(w) - k + 2 as bigint))) as i
        from d join (select distinct k from bw) on len(w) >= k)
), h as (
  select doc_id, dw.k, i, item_id from dw join bw on dw.k = bw.k and dw.win = bw.win
), hw as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from h) group by 1
), hi as (
  select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as items
  from (select distinct doc_id, cast(item_id as varchar) as s from h) group by 1
)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hw using (doc_id) left join hi using (doc_id)
"""

ORACLES["op9_remove_repeats"] = r"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), x as (
  select doc_id, i, array_to_string(w[i:i + 19], ' ') as win
  from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)
), r as (
  select doc_id, i from (select doc_id, i, row_number() over (partition by win order by doc_id, i) as k from x) where k > 1
), p as (
  select doc_id, list(distinct q) as gone from (select doc_id, unnest(range(i, i + 20)) as q from r) group by 1
), k as (
  select doc_id, w, coalesce(gone, []) as gone,
    string_agg(w[j], ' ' order by j) filter (where not list_contains(coalesce(gone, []), j)) as kept
  from (select doc_id, w, gone, unnest(range(1, len(w) + 1)) as j from d left join p using (doc_id)) group by 1, 2, 3
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256
from d left join k on d.doc_id = k.doc_id
"""

ORACLES["op4_top_k"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id,
    cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10
"""

ORACLES["op5_archive_pages"] = """
with p as (
  select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), k as (
  select payload_digest, payload_bytes, max(page_id) as keeper from p where payload_bytes >= 1000 group by 1, 2
)
select page_id, p.payload_bytes, p.payload_digest,
  case when keeper is null or keeper = page_id then 'response' else 'revisit' end as record_type,
  case when keeper <> page_id then keeper end as refers_to
from p left join k on p.payload_digest = k.payload_digest and p.payload_bytes = k.payload_bytes
"""

ORACLES["op1_mix_sources"] = r"""
with recursive d as (
  select doc_id, coalesce(source, '(none)') as source, source as own,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as tokens,
    md5('0:' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')) as key from documents
), s as (
  select source, count(*) as docs, cast(sum(tokens) as bigint) as tokens from d group by 1
), l as (
  select list(ln(tokens / total) order by source) as lp, count(*) as n, min(ln(tokens / total)) as low
  from (select *, (select sum(tokens) from s) as total from s) where tokens > 0
), e(i, lo, hi) as (
  select 0, 0.0::double, 1.0::double union all
  select i + 1,
    case when h then (lo + hi) / 2 else lo end, case when h then hi else (lo + hi) / 2 end
  from (select i, lo, hi,
    ln(list_sum(list_transform(lp, lambda x: exp((lo + hi) / 2 * x))))
      - (lo + hi) / 2 * list_sum(list_transform(lp, lambda x: exp((lo + hi) / 2 * x) * x))
        / list_sum(list_transform(lp, lambda x: exp((lo + hi) / 2 * x))) >= 0.95 * ln(n) as h
    from e, l where i < 40)
), r(i, lo, hi) as (
  select 0, 0.0::double, 1.0::double union all
  select i + 1,
    case when h then (lo + hi) / 2 else lo end, case when h then hi else (lo + hi) / 2 end
  from (select i, lo, hi,
    exp(((lo + hi) / 2 - 1) * low) / list_sum(list_transform(lp, lambda x: exp((lo + hi) / 2 * x))) > 4.0 as h
    from r, l where i < 40)
), a as (
  select case when n < 2 then 1.0 else greatest(
    (select (lo + hi) / 2 from e where i = 40), (select (lo + hi) / 2 from r where i = 40)) end as a from l
), w as (
  select source, docs, tokens, total, case when tokens > 0 then exp(a * ln(tokens / total)) else 0 end as power
  from (select *, (select sum(tokens) from s) as total from s), a
), q as (
  select source, tokens as total_s, power / (select sum(power) from w) as weight,
    cast(round(power / (select sum(power) from w) * total) as bigint) as quota, cast(ceil(sqrt(docs)) as bigint) as blocks from w
), b as (
  select doc_id, own, tokens, key, q.*, ('0x' || substr(key, 1, 8))::bigint % blocks as block from d join q using (source)
), p as (
  select *, cast(sum(tokens) over (partition by source order by block, key rows unbounded preceding) as bigint) as place from b
)
select doc_id, own as source, tokens as mix_tokens, round(weight, 8) as mix_weight, quota as mix_quota, block as mix_block, place as mix_place,
  cast(case when total_s = 0 then 1 else quota // total_s + case when place <= quota % total_s and tokens > 0 then 1 else 0 end end as bigint) as mix_copies
from p
"""

ORACLES["op13_drop_lines"] = r"""
with l as (
  select doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as i from documents)
), c as (
  select k, count(distinct doc_id) as docs, max(doc_id) as last from l where length(k) >= 40 group by 1
), f as (
  select l.doc_id, i, line, coalesce(docs >= 5 and l.doc_id < last, false) as gone from l left join c using (k)
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from f group by 1
"""

ORACLES["op11_search_items"] = r"""
with d as (
  select doc_id, w, len(w) as n from (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents) where len(w) > 0
), s as (
  select count(*) as nn, cast(sum(n) as bigint) as ll from d
), q as (
  select item_id, t, count(*) as r from (
    select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as t from benchmark) group by 1, 2
), p as (
  select doc_id, n, t, count(*) as tf from (select doc_id, n, unnest(w) as t from d) group by 1, 2, 3
), f as (
  select t, cast(floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)::double)) as bigint) as w
  from (select t, count(*) as df from p group by 1), s
), x as (
  select item_id, doc_id, cast(sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)))) as bigint) as score
  from q join p using (t) join f using (t), s group by 1, 2
), k as (
  select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from x where score > 0
)
select item_id, cast(rank as int) as rank, doc_id, score from k where rank <= 20
"""
