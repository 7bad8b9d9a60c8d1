"""Connected components of a graph given as links, without ever holding a component in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import cut

#: Links that a task holds before it replaces them by counts and a spanning forest.
HELD_LINKS = 1_000_000
#: Links that one task takes in whole, 16 bytes each; more go through rounds of joins.
WHOLE_LINKS = 2_000_000


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that connect what the given links connect: at most one a node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        # hook every larger root under the smallest root beside it, then halve the paths
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low != high
        x, y, low, high = x[apart], y[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def fold_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b, n_a, n_b) to rows (node, root, links): partial link counts, and forest links (links null), linear in the nodes seen."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def fold() -> pa.RecordBatch:
        a, b, na, nb = (np.concatenate(x) for x in zip(*held))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        count = np.zeros(len(nodes), np.int64)
        np.add.at(count, at, np.concatenate([nb, na]))
        u, v = spanning_forest(a, b)
        none = len(nodes)
        return pa.record_batch(
            {
                "node": pa.array(np.concatenate([nodes, u])),
                "root": pa.array(np.concatenate([nodes, v])),
                "links": pa.array(np.concatenate([count, np.zeros(len(u), np.int64)]), mask=np.arange(none + len(u)) >= none),
            }
        )

    for batch in batches:
        if batch.num_rows:
            held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in ("a", "b", "n_a", "n_b")))
            size += batch.num_rows
        if size >= HELD_LINKS:
            yield fold()
            held, size = [], 0
    if held:
        yield fold()


FOLDED = "node long, root long, links long"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (u, v) to each node with the smallest node that it reaches."""
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if held:
        a, b = map(np.concatenate, zip(*held))
        node, root = spanning_forest(a, b)
        tops = np.setdiff1d(np.concatenate([a, b]), node)
        yield pa.record_batch({"node": pa.array(np.concatenate([node, tops])), "component": pa.array(np.concatenate([root, tops]))})


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (src long, dst long) to (node, component): each node of an edge with the smallest node that it reaches.

    Links counted to be few are taken in by one task. More alternate the large-star and small-star steps (Kiveris et al. 2014) until the
    links are stars, and are written to the shared checkpoint folder after each round. Nulls, loops and repeated links are dropped;
    without links the result is empty.
    """
    e = (
        edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    e = cut(e)

    def state() -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = state()
    if seen[0] <= WHOLE_LINKS:
        return e.coalesce(1).mapInArrow(_whole, "node long, component long")
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        # a node with one smaller neighbour keeps it; the others' links go to the smallest
        e = cut(small.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("x")).select(F.col("x.a").alias("u"), F.col("x.b").alias("v")).where("u != v").distinct())
        before, seen = seen, state()
        if seen == before:
            break
    own = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(own)
