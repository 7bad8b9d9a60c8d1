"""What is indexed: codebases with their counts, files, embeddings that are stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def list_codebases(codebases: DataFrame, files: DataFrame) -> DataFrame:
    """(id, root_path, name, indexed_at, file_count, chunk_count) by root path; codebases without files count zero.

    Files are summed up by codebase before the join, so its right side is one row a codebase.
    """
    counts = files.groupBy(F.col("codebase_id").alias("id")).agg(F.countDistinct("file_path").alias("file_count"), F.sum("chunk_count").cast("long").alias("chunk_count"))
    return codebases.join(counts, "id", "left").select("id", "root_path", "name", "indexed_at", F.coalesce("file_count", F.lit(0)).alias("file_count"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count")).orderBy("root_path")


def list_files(files: DataFrame, codebase_id: int | None = None) -> DataFrame:
    return (files if codebase_id is None else files.where(F.col("codebase_id") == codebase_id)).orderBy("file_path")


def total_chunks(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("long").alias("chunks"))


def is_stale(model: str) -> Column:
    return F.col("embedding").isNull() | (F.col("embedding_model") != model)


def stale_counts(chunks: DataFrame, model: str) -> DataFrame:
    """(codebase_id, stale, embedded)."""
    return chunks.groupBy("codebase_id").agg(F.sum(is_stale(model).cast("int")).cast("long").alias("stale"), F.count("embedding").alias("embedded"))


def stale(chunks: DataFrame, model: str, limit: int = 0) -> DataFrame:
    """Chunks to embed; a limit of 0 is none."""
    rows = chunks.where(is_stale(model))
    return rows.limit(limit) if limit else rows


def within(root: Column, path: str | Column) -> Column:
    """Whether a path is a root or lies below it."""
    p = F.lit(path) if isinstance(path, str) else path
    return (p == root) | F.startswith(p, F.concat(root, F.lit("/")))


def codebase_of(paths: DataFrame, path: str, codebases: DataFrame) -> DataFrame:
    """Rows of `paths` with the root_path of the longest root that holds theirs; those in none are left out.

    A path is joined with the roots that are equal to its leading parts, so the join is on equality and neither side has to be small.
    """
    roots = codebases.select("root_path").distinct()
    parts = F.split(path, "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    found = paths.withColumn("__i", F.monotonically_increasing_id()).withColumn("root_path", F.explode(heads)).join(roots, "root_path")
    best = found.withColumn("__n", F.expr("row_number() over (partition by __i order by length(root_path) desc)")).where("__n = 1")
    return best.select(*paths.columns, "root_path")


def current_codebase(codebases: DataFrame, path: str) -> DataFrame:
    """The codebase with the longest root that holds the path."""
    return codebases.where(within(F.col("root_path"), path)).orderBy(F.desc(F.length("root_path"))).limit(1)
