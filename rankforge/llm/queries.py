"""Registered queries of the corpus operators, and DuckDB queries for those that SQL can express."""

from __future__ import annotations

from . import ann, jaccard, katz, langid, mixing, negatives, periods, pieces, secrets, substrings, toxicity, warc, webp

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_sentencepiece": pieces.op2,
    "op3_media_webp": webp.op3,
    "op4_katz_lm": katz.op4,
    "op5_warc": warc.op5,
    "op6_jaccard_join": jaccard.op6,
    "op7_mix_sources": mixing.op7,
    "op8_language_id": langid.op8,
    "op9_ann_partitions": ann.op9,
    "op10_secret_scan": secrets.op10,
    "op11_periodic_runs": periods.op11,
    "op12_hard_negatives": negatives.op12,
    "op13_substring_dedup": substrings.op13,
}

ORACLES = {
    "op5_warc": """
select page_id, n as payload_bytes, digest as payload_digest, case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id <> first then first end as refers_to
from (select page_id, cast(strlen(coalesce(html, '')) as bigint) as n, sha256(coalesce(html, '')) as digest, min(page_id) over (partition by coalesce(html, '')) as first from pages) p""",
    "op6_jaccard_join": """
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
sets as (
  select doc_id, case when len(w) >= 4 then list_distinct([concat_ws(chr(10), w[i], w[i + 1], w[i + 2], w[i + 3]) for i in range(1, len(w) - 2)]) when len(w) > 0 then [array_to_string(w, chr(10))] else [] end as g from words),
items as (select doc_id, unnest(g) as x, len(g) as n from sets),
pairs as (
  select a.doc_id as a, b.doc_id as b from items a join items b on a.x = b.x and a.doc_id < b.doc_id and 85 * a.n <= 100 * b.n and 85 * b.n <= 100 * a.n
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges as (select a, b from pairs union all select b, a from pairs),
reach as (select doc_id as id, doc_id as c from documents union select e.b, r.c from reach r join edges e on e.a = r.id)
select s.doc_id, cast(len(g) as bigint) as n_shingles, r.c as component_id from sets s join (select id, min(c) as c from reach group by 1) r on r.id = s.doc_id""",
    "op12_hard_negatives": """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_inner_product(a.q, b.q) as bigint) as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (
  select anchor_id, id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (
  select p.anchor_id, p.positive_id, p.positive_score, s.id as negative_id, s.score as negative_score,
    cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.id) as integer) as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10""",
    "op13_substring_dedup": """
with words as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
places as (select doc_id, w, len(w) as n, unnest(range(1, len(w) - 18)) as i from words),
starts as (select doc_id, i, row_number() over (partition by md5(array_to_string(w[i:i + 19], ' ')) order by doc_id, i) > 1 as again from places),
later as (select doc_id, list(i) as s from starts where again group by doc_id),
gone as (select doc_id, list_distinct(flatten(list_transform(s, lambda b: range(b, b + 20)))) as g from later),
kept as (
  select w.doc_id, len(w.w) as n, coalesce(len(g), 0) as removed, case when g is null then w.w else list_filter(w.w, lambda x, b: not list_contains(g, b)) end as k from words w left join gone using (doc_id))
select doc_id, cast(n as bigint) as n_words, cast(removed as bigint) as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept""",
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
