"""Retrieval quality: hits, accuracy at k, mean reciprocal rank, rollups, head-to-head, and a pattern-count baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_hit(path: Column, name: Column, expected_files: Column, expected_names: Column | None = None) -> Column:
    """Whether the path ends with an expected file, or the name equals or holds an expected name."""
    hit = F.exists(expected_files, lambda s: F.endswith(path, s))
    if expected_names is not None:
        hit = hit | F.exists(F.coalesce(expected_names, F.array().cast("array<string>")), lambda n: F.contains(name, n))
    return F.coalesce(hit, F.lit(False))


def first_hits(ranked: DataFrame, queries: DataFrame, hit: str = "hit", query: str = "query_id") -> DataFrame:
    """Each query of `queries` with `first`, the rank of its first hit, null if none."""
    found = ranked.where(F.col(hit)).groupBy(query).agg(F.min("rank").alias("first"))
    return queries.join(found, query, "left")


def quality(first: DataFrame, by: tuple[str, ...] = (), ks: tuple[int, ...] = (1, 3, 5), total: bool = False) -> DataFrame:
    """n, top1, top3, top5 (shares) and mrr, over all or by group; `total` adds a row with null groups for all."""
    aggs = [F.count("*").alias("n"), *[F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))).alias(f"top{k}") for k in ks], F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr")]
    return (first.rollup(*by) if total and by else first.groupBy(*by)).agg(*aggs)


def tier(first: Column, fifth: bool = True) -> Column:
    """3 for a hit at rank 1, 2 up to rank 3, 1 up to rank 5 (only if `fifth`), else 0."""
    t = F.when(first == 1, 3).when(first <= 3, 2)
    return F.coalesce((t.when(first <= 5, 1) if fifth else t).otherwise(0), F.lit(0))


def head_to_head(a: Column, b: Column) -> list[Column]:
    """Aggregates of tiers: wins of a, wins of b, ties."""
    return [F.count_if(a > b).alias("wins"), F.count_if(a < b).alias("losses"), F.count_if(a == b).alias("ties")]


def pattern_counts(docs: DataFrame, key: str, text: str, patterns: list[str], k: int = 5) -> DataFrame:
    """(key, matches): the k rows in which most of the patterns match, ties by key. One scan, a sum of tests a row, no join."""
    n = sum((F.rlike(F.col(text), F.lit(p)).cast("int") for p in patterns), F.lit(0))
    return docs.select(key, F.coalesce(n, F.lit(0)).alias("matches")).where("matches > 0").orderBy(F.desc("matches"), key).limit(k)
