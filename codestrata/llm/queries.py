"""Registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, exact_dedup, hard_negatives, language, max_sketch, packing, quality, simhash, suffixes, surrogates, topk, toxicity, winnowing
from .common import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return put


def _classified(scores: DataFrame, modulus: int, held_out: int) -> DataFrame:
    return scores.select("doc_id", (remainder("doc_id", modulus) == held_out).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: The key of the registered query; a user of the operator passes a secret one.
KEY = b"codestrata example key"


@registered("op1_pii_surrogates")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.surrogate_texts(table(spark, sf_dir, "documents"), KEY)


@registered("op2_bradley_terry_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.trained(docs, table(spark, sf_dir, "labels"))
    return _classified(quality.quality_scores(docs, model), quality.MODULUS, quality.HELD_OUT)


@registered("op3_recursive_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, pattern), path)
    return rows.select("doc_id", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@registered("op4_bucket_refinement", """
with texts as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
bytes as (select doc_id, cast(p as bigint) as p, substring(h, 2 * p + 1, 2) as byte, case when 2 * p + 200 <= length(h) then md5(substring(h, 2 * p + 1, 200)) end as string
  from texts, unnest(range(length(h) // 2)) as r(p)),
known as (select *, string is not null and row_number() over (partition by string order by doc_id, p) > 1 as again from bytes),
marked as (select *, bool_or(again) over (partition by doc_id order by p rows between 99 preceding and current row) as gone from known),
runs as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by p), false) as opens from marked),
counted as (select doc_id, count(*) as n_bytes, count(*) filter (where gone) as n_removed, count(*) filter (where opens) as n_spans,
  sha256(unhex(coalesce(string_agg(byte, '' order by p) filter (where not gone), ''))) as kept_sha256 from runs group by doc_id)
select t.doc_id, coalesce(n_bytes, 0) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, coalesce(kept_sha256, sha256(unhex(''))) as kept_sha256
from texts t left join counted c on c.doc_id = t.doc_id""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@registered("op5_block_pruned_top_k", """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.exact_top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


@registered("op6_simhash_components")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_components(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@registered("op7_hierarchical_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@registered("op8_rank_order_language")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.learn(docs))
    return found.select("doc_id", (remainder("doc_id", language.MODULUS) == language.HELD_OUT).alias("held_out"), "lang_pred", "score")


@registered("op9_toxic_segments")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.toxic_passages(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))
    return _classified(found, toxicity.MODULUS, toxicity.HELD_OUT)


@registered("op10_exact_dedup", """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
       count(*) over (partition by coalesce(text, '')) as group_size,
       doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept, sha256(coalesce(text, '')) as text_sha256
from documents""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@registered("op11_max_sketch_search", rf"""
with term as (select doc_id, t, count(*) as tf from (
    select doc_id, unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from documents) group by all),
sized as (select doc_id, cast(sum(tf) as bigint) as n from term group by doc_id),
total as (select count(*) as docs, cast(sum(n) as bigint) as words from sized),
damped as (select doc_id, 50 + (50 * n * docs) // words as m from sized, total),
asked as (select distinct item_id, t from (select item_id, unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark)),
weight as (select t, cast(floor(1000 * ln(cast(2 * any_value(docs) + 2 as double) / (2 * count(*) + 1))) as bigint) as w from term, total group by t),
scored as (select a.item_id, x.doc_id, cast(sum(w.w * ((1000000000 * x.tf) // (1000 * x.tf + 20 * d.m))) as bigint) as score
  from asked a join term x on x.t = a.t join weight w on w.t = a.t join damped d on d.doc_id = x.doc_id group by all)
select item_id, cast(rank as integer) as rank, doc_id, score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0) where rank <= 50""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_sketch.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@registered("op12_winnowing_decontamination", rf"""
with doc as (select doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
item as (select item_id, w, least(len(w), 10) as n from (select item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark) where len(w) > 0),
passage as (select distinct item_id, n, array_to_string(w[s:s + n - 1], ' ') as p from (select *, unnest(range(1, len(w) - n + 2)) as s from item)),
lengths as (select distinct n from passage),
span as (select doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') as p from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from doc, lengths)),
found as (select span.doc_id, span.n, span.s, passage.item_id from span join passage on passage.n = span.n and passage.p = span.p),
hit as (select doc_id, count(distinct word) as n_hit from (select doc_id, unnest(range(s, s + n)) as word from found) group by doc_id),
of_doc as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as items from (select distinct doc_id, cast(item_id as varchar) as i from found) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc d left join hit h on h.doc_id = d.doc_id left join of_doc o on o.doc_id = d.doc_id""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                       F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@registered("op13_strassen_hard_negatives", """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where label is not null and vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, cast(list_inner_product(cast(a.v as double[]), cast(c.v as double[])) as bigint) as score
  from v a join v c on c.vec_id <> a.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as integer) as rank,
  s.vec_id as negative_id, p.positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
qualify rank <= 10""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = hard_negatives.labelled_vectors(table(spark, sf_dir, "embeddings"))
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(vectors, vectors.where("vec_id % 100 = 0"))
