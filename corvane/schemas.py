"""Schemas of the stored tables and of results; nothing is ever inferred from data."""

from pyspark.sql import types as T


def _s(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in ((*f, True)[:3] for f in fields)])


STR, LONG, INT, DBL = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
VECTOR = T.ArrayType(T.FloatType())

CODEBASES = _s(("id", LONG), ("root_path", STR), ("name", STR), ("indexed_at", LONG))
CHUNK = _s(("file_path", STR), ("chunk_key", STR), ("language", STR), ("kind", STR), ("name", STR), ("signature", STR), ("snippet", STR), ("start_line", INT), ("end_line", INT), ("file_hash", STR))
CHUNKS = T.StructType([T.StructField("codebase_id", LONG), *CHUNK.fields, *_s(("indexed_at", LONG), ("embedding", VECTOR), ("embedding_model", STR)).fields])
INDEXED_FILES = _s(("codebase_id", LONG), ("file_path", STR), ("file_hash", STR), ("chunk_count", INT), ("indexed_at", LONG))
SCANNED = _s(("abs_path", STR), ("rel_path", STR), ("language", STR), ("hash", STR), ("content", STR), ("error", STR))
POSTINGS = _s(("codebase_id", LONG), ("chunk_key", STR), ("field", STR), ("term", STR), ("tf", LONG), ("dl", LONG))
FIELD_STATS = _s(("codebase_id", LONG), ("field", STR), ("n", LONG), ("total", LONG))
RESULT = _s(("chunk_key", STR), ("file_path", STR), ("name", STR), ("kind", STR), ("signature", STR), ("snippet", STR), ("start_line", INT), ("end_line", INT), ("score", DBL))
