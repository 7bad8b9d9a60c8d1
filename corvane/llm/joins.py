"""Joins with a table that is broadcast only if its measured size allows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a table's rows up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def sized(df: DataFrame, row: int | Column) -> DataFrame:
    """`df`, which should be computed already, hinted to be broadcast or merged. row: bytes of a row."""
    size = df.agg(F.sum(F.lit(row) if isinstance(row, int) else row)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df.hint("merge")
