"""The registered queries of this subpackage, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import embeddings, html_tree, importance, jaccard, line_dedup, mixing, negatives, packing, passages, quality, token_rollup, topk, warc
from .common import parted, scratch, stored


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_soft_mixing(spark, sf_dir):
    return mixing.rates(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), keep="clean")


def op2_token_counts(spark, sf_dir):
    """Three batches: all documents; those labelled 0 are deleted, those labelled toxic revised without upper case; the second again."""
    docs, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    store = token_rollup.RollupStore(spark, scratch(spark, "rollup"), {"words-1": token_rollup.word_counter, "byte-bpe-50k": token_rollup.bpe_counter})
    store.commit(1, docs.select(F.lit("insert").alias("op"), "doc_id", "text", "source", "lang"))
    marks = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).filter("quality = 0 or toxic = 1")
    changes = parted(docs, "doc_id", marks := stored(marks, "marks"))[0].join(marks.hint("merge"), "doc_id").select(F.when(F.col("quality") == 0, "delete").otherwise("revise").alias("op"), "doc_id", F.lower("text").alias("text"), "source", "lang")
    store.commit(2, changes)
    store.commit(2, changes)
    return store.totals()


def op3_substring_dedup(spark, sf_dir):
    return passages.passages(_t(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(_t(spark, sf_dir, "documents"))


def op5_warc(spark, sf_dir):
    return warc.round_trip(_t(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_embedding_near_dedup(spark, sf_dir):
    return embeddings.near_duplicates(_t(spark, sf_dir, "embeddings"))


def op7_best_fit_packing(spark, sf_dir):
    return packing.packed(_t(spark, sf_dir, "documents"))


def op8_exact_top_k(spark, sf_dir):
    return topk.top_inner(_t(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_html_extraction(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages")
    return html_tree.extract(pages, html_tree.fit(pages))


def op10_quality_classifier(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _t(spark, sf_dir, "labels")))


def op11_hard_negatives(spark, sf_dir):
    """Labels of rows whose vec_id is divisible by 7 are moved on by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_t(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


def op12_line_dedup(spark, sf_dir):
    return line_dedup.digests(_t(spark, sf_dir, "documents"))


def op13_importance_resampling(spark, sf_dir):
    return importance.resample(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_soft_mixing, op2_token_counts, op3_substring_dedup, op4_ngram_jaccard_join, op5_warc, op6_embedding_near_dedup, op7_best_fit_packing, op8_exact_top_k, op9_html_extraction, op10_quality_classifier,
        op11_hard_negatives, op12_line_dedup, op13_importance_resampling)
}

#: Queries that SQL can express; the others are held against brute force, exact round trips or held-out accuracy in tests.
ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard_join": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sh as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) as s from w),
n as (select doc_id, count(*) as n from sh group by doc_id),
met as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from met join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
reach as (select doc_id as id, doc_id as r from documents union select id, b from reach join links on r = a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, case when len(w) = 0 then w.doc_id else min(w.doc_id) over (partition by w) end as class_id
from w left join n on n.doc_id = w.doc_id join (select id, min(r) as component_id from reach group by id) c on c.id = w.doc_id""",
    "op5_warc": r"""
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select *, min(page_id) over (partition by h) as first_id,
  list_transform(range(0, 8), lambda i: cast('0x' || substr(sha1(h), cast(5 * i + 1 as int), 5) as int)) as v from p)
select page_id, cast(octet_length(encode(h)) as bigint) as payload_bytes,
  array_to_string(list_transform(v, lambda x: array_to_string(list_transform([32768, 1024, 32, 1], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((x // k) % 32 + 1 as int), 1)), '')), '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type, case when page_id <> first_id then first_id end as refers_to from d""",
    "op6_embedding_near_dedup": r"""
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
reach as (select vec_id as id, vec_id as r from embeddings union select id, b from reach join links on r = a)
select e.vec_id, coalesce(d.n, 0) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e left join (select a, count(*) as n from links group by a) d on d.a = e.vec_id join (select id, min(r) as component_id from reach group by id) c on c.id = e.vec_id""",
    "op8_exact_top_k": r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5""",
    "op11_hard_negatives": r"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, cast(list_dot_product(a.e, c.e) as bigint) as score
  from v a join v c on a.vec_id % 100 = 0 and a.vec_id <> c.vec_id),
p as (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as r from s where same),
n as (
  select anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by anchor_id, p.vec_id order by s.score desc, s.vec_id) as rank
  from p join s using (anchor_id) where p.r <= 5 and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 10""",
    "op12_line_dedup": r"""
with d as (select row_number() over () as id, doc_id, string_split(coalesce(text, ''), chr(10)) as x from documents),
l as (select id, doc_id, unnest(x) as line, generate_subscripts(x, 1) as i from d),
k as (select *, translate(trim(line, concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key, max(doc_id) as stays from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
m as (select k.*, coalesce(doc_id < stays, false) as gone from k left join f using (key))
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from m group by id""",
    "op13_importance_resampling": r"""
with recursive c as (select i, 0 as k, i as c from range(256) r(i) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from c where k < 8),
tab as (select list(c order by i) as t from c where k = 8),
x as (
  select 0 as own, doc_id, row_number() over () as id, coalesce(text, '') as text from documents union all select 1, null, row_number() over (), coalesce(text, '') from benchmark),
f as (select own, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from x),
h as (select w, hex(encode(w)) as h from (select distinct w from f)),
b as (
  select w, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, length(h) // 2), lambda i: cast('0x' || substr(h, cast(2 * i + 1 as int), 2) as bigint))),
    lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1])), 4294967295::bigint) % 10000 as b from h, tab),
n as (select b, count(*) filter (own = 0) as s, count(*) filter (own = 1) as t from f join b using (w) group by b),
z as (select cast(coalesce(sum(s), 0) as bigint) as s, cast(coalesce(sum(t), 0) as bigint) as t from n),
g as (select b, floor(1000 * ln(((n.t + 1)::double * (z.s + 10000)::double) / ((n.s + 1)::double * (z.t + 10000)::double))) as g from n, z),
d as (select id, count(*) as n_features, cast(floor(sum(g) / count(*)) as bigint) as weight from f join b using (w) join g using (b) where own = 0 group by id),
e as (
  select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8) as bigint) + 0.5) / 4294967296))) as bigint) as score
  from x left join d using (id) where own = 0),
r as (select *, n_features >= 20 as able, row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls last, n_features) as r, count(*) filter (n_features >= 20) over () as n from e)
select doc_id, n_features, weight, score, case when able and r <= 10 * n // 100 then r end as rank from r""",
}
