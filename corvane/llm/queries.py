"""The registered queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import ann, bpe, embed_dedup, html_wrapper, langid, mixing, pii, simhash, token_counts, url_filter
from corvane.session import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", heavy=True))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.main_text(table(spark, sf_dir, "pages", heavy=True))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents", heavy=True), RANKS, public_tokenizers.PATTERN)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents", heavy=True))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings", heavy=True))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents", heavy=True), RANKS, public_tokenizers.PATTERN)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings", heavy=True), F.col("vec_id") % 50 == 0)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents", heavy=True))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_html_text, op3_token_counts, op4_mixing, op5_language_id, op6_embedding_dedup, op7_url_filter, op8_bpe, op9_nearest, op10_pii)}

_USABLE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"

ORACLE_SQL: dict[str, str] = {
    "op6_embedding_dedup": f"""
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and {_USABLE}),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.93::double),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, least(e.vec_id, coalesce(c.c, e.vec_id)) as component_id, e.vec_id = least(e.vec_id, coalesce(c.c, e.vec_id)) as kept
from embeddings e left join (select a, count(*) as n from links group by a) n on n.a = e.vec_id left join (select a, min(b) as c from reach group by a) c on c.a = e.vec_id""",
    "op7_url_filter": url_filter.oracle_sql(),
    "op9_nearest": f"""
with v as (select vec_id, embedding::double[] as e from embeddings where {_USABLE}),
s as (select a.vec_id as query_id, b.vec_id, list_cosine_similarity(a.e, b.e) as score from v a join v b on a.vec_id <> b.vec_id and a.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5""",
}
