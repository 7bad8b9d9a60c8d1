"""Batches of long texts, a few at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(texts: pa.Array, rows: int = 512, size: int = 4 << 20) -> Iterator[list[str | None]]:
    """A batch's texts in turn, so that few of them, or one long one, stand in memory twice."""
    lengths = pc.binary_length(texts) if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else pc.list_value_length(texts)
    n = pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < len(texts):
        own = n[at : at + rows]
        k = max(1, int(np.searchsorted(np.cumsum(own), size, side="right")))
        yield texts.slice(at, min(k, len(own))).to_pylist()
        at += min(k, len(own))
