"""Cosine and 8-bit quantisation of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the expected length as doubles, and which rows these are."""
    ok = np.array(column.is_valid()) & (np.array(pa.compute.list_value_length(column).fill_null(-1)) == dim)
    flat = column.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dim), ok


def cosine_to(query: list[float]):
    """A function of an array column: its cosine with `query` in double precision, null for null and for other lengths.

    One matrix product an Arrow batch. The built-in higher-order functions give the same but are interpreted element by element.
    """
    q = np.asarray(query, np.float64)
    norm = np.sqrt(q @ q)

    @F.arrow_udf(DoubleType())
    def of(v: pa.Array) -> pa.Array:
        x, ok = _rows(v, len(q))
        out = np.full(len(v), np.nan)
        with np.errstate(invalid="ignore", divide="ignore"):
            out[ok] = (x @ q) / (np.sqrt((x * x).sum(1)) * norm)
        return pa.array(out, pa.float64(), mask=~np.isfinite(out))

    return of


def score(cosine: Column) -> Column:
    """One minus the distance; a missing distance counts as one."""
    return F.lit(1.0) - F.coalesce(F.lit(1.0) - cosine, F.lit(1.0))


def quantise(vector: Column) -> Column:
    """struct(alpha, shift, codes): x is about alpha * code + shift, codes from 0 to 255; a constant vector has alpha 0 and codes 0."""
    v = vector.cast("array<double>")
    low, high = F.array_min(v), F.array_max(v)
    alpha = (high - low) / F.lit(255.0)
    codes = F.transform(v, lambda x: F.when(alpha > 0, F.floor((x - low) / alpha + F.lit(0.5))).otherwise(0).cast("int"))
    return F.when(vector.isNotNull(), F.struct(alpha.alias("alpha"), low.alias("shift"), codes.alias("codes")))


def sum_of(codes: Column, power: int = 1) -> Column:
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: a + (x if power == 1 else x * x).cast("long"))


def quantised_cosine(a: Column, b: Column, dim: int) -> Column:
    """Cosine of two quantised vectors from whole-number sums."""
    qa, qb = a["codes"], b["codes"]
    sa, sb, n = sum_of(qa), sum_of(qb), F.lit(float(dim))
    cross = F.aggregate(F.zip_with(qa, qb, lambda x, y: (x * y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    dot = a["alpha"] * b["alpha"] * cross + a["alpha"] * b["shift"] * sa + a["shift"] * b["alpha"] * sb + n * a["shift"] * b["shift"]
    square = lambda v, s: v["alpha"] * v["alpha"] * sum_of(v["codes"], 2) + F.lit(2.0) * v["alpha"] * v["shift"] * s + n * v["shift"] * v["shift"]
    return dot / F.sqrt(square(a, sa) * square(b, sb))
