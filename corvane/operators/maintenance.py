"""Incremental maintenance: what changed, what goes, and how rows replace rows. All set at a time, on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_diff(scan: DataFrame, state: DataFrame, keys: tuple[str, ...] = ("codebase_id", "file_path"), hash_col: str = "file_hash") -> DataFrame:
    """The keys of both sides with `status`: added, changed, unchanged or removed."""
    a = scan.select(*keys, F.col(hash_col).alias("new_hash"), F.lit(1).alias("__a"))
    b = state.select(*keys, F.col(hash_col).alias("old_hash"), F.lit(1).alias("__b"))
    status = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "removed").when(F.col("new_hash").eqNullSafe(F.col("old_hash")), "unchanged").otherwise("changed")
    return a.join(b, list(keys), "full_outer").select(*keys, status.alias("status"))


def changed(scan: DataFrame, state: DataFrame, keys: tuple[str, ...] = ("codebase_id", "file_path"), hash_col: str = "file_hash") -> DataFrame:
    """Scanned rows that aren't stored with this hash."""
    return scan.join(state.select(*keys, hash_col), [*keys, hash_col], "left_anti")


def gone(state: DataFrame, scan: DataFrame, keys: tuple[str, ...] = ("codebase_id", "file_path")) -> DataFrame:
    """Stored rows whose file is no longer scanned."""
    return state.join(scan.select(*keys), list(keys), "left_anti")


def without(stored: DataFrame, files: DataFrame, keys: tuple[str, ...] = ("codebase_id", "file_path")) -> DataFrame:
    """Stored rows of other files than these."""
    return stored.join(files.select(*keys), list(keys), "left_anti")


def replace_by_file(stored: DataFrame, files: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("codebase_id", "file_path")) -> DataFrame:
    """Stored rows without those of `files`, and the new rows; a file may have none."""
    return stored.join(files.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def last_wins(rows: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """Of each key the row with the highest `order`, which must differ within a key."""
    return rows.withColumn("__n", F.expr(f"row_number() over (partition by {', '.join(key)} order by {order} desc)")).where("__n = 1").drop("__n")


def upsert_chunks(stored: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Chunks by their global key: a new one takes over the stored row's codebase and contents but not its file path, and has no embedding yet.

    Of new rows with one key the last in `order` wins. The stored row's path stays, as another codebase may have written it.
    """
    fresh = last_wins(new, ("chunk_key",), order).drop(order)
    paths = stored.select("chunk_key", F.col("file_path").alias("__path"))
    fresh = fresh.join(paths, "chunk_key", "left").withColumn("file_path", F.coalesce("__path", "file_path")).drop("__path")
    fresh = fresh.withColumn("embedding", F.lit(None).cast(stored.schema["embedding"].dataType)).withColumn("embedding_model", F.lit(""))
    return stored.join(fresh.select("chunk_key"), "chunk_key", "left_anti").select(*stored.columns).unionByName(fresh.select(*stored.columns))


def write_embeddings(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with the vectors (chunk_key, embedding, embedding_model) put in."""
    v = vectors.select("chunk_key", F.col("embedding").alias("__e"), F.col("embedding_model").alias("__m"))
    return chunks.join(v, "chunk_key", "left").withColumn("embedding", F.coalesce("__e", "embedding")).withColumn("embedding_model", F.coalesce("__m", "embedding_model")).select(*chunks.columns)
