"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by the pivots (reference points) nearest to it, in order. Every vector is entered in the inverted lists
of its pivots; vectors that share at least `SHARED` of their `NEAREST` pivots are candidates, and their cosine decides.
A list is kept for each set of SHARED pivots rather than for each pivot, which retrieves exactly the pairs with that
shared-pivot count without counting within long lists. A pair that shares several sets is compared under the first only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, ShortType
from pyspark.sql.window import Window

from corvane.llm.components import FOLDED, connected_components, fold_links
from corvane.llm.vectors import dots, matrix, usable
from corvane.session import cut, workers_can_import

#: The index is fitted on a sample of so many vectors of each length at most; every vector is indexed and compared.
SAMPLE = 16_384
#: Pivots: so many times the root of the number of vectors, within these bounds, so that lists stay short as the table grows.
PIVOTS_A_ROOT, LEAST_PIVOTS, MOST_PIVOTS = 8, 1024, 4095
#: Pivots lie apart: at a lower cosine than this, well below that of links. Otherwise a dense group would hold many pivots,
#: and its members would each have others nearest.
APART = 0.75
NEAREST, SHARED = 9, 3
#: Vectors of a list that meet in one task; longer lists are cut into blocks of so many, and every two blocks meet.
BLOCK = 2048
#: Pairs that are compared at once.
AT_ONCE = 1 << 18


def spread(x: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` rows of x (unit vectors), each the one farthest from those before, as long as they lie apart."""
    chosen, near = [0], x @ x[0]
    while len(chosen) < most and near.min() < APART:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def _triples(tops: np.ndarray) -> np.ndarray:
    """Numbers of the sets of SHARED pivots out of ascending pivots, a row each."""
    t = min(SHARED, tops.shape[1])
    return np.stack([sum(tops[:, i].astype(np.int64) << (12 * k) for k, i in enumerate(c)) for c in combinations(range(tops.shape[1]), t)], 1)


def pairs_of_sorted(group: np.ndarray, side: np.ndarray, later: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i < j of the same group with j in `later` (if given), in portions. side: -1 where all of a group meet, else 0 or 1 and only different sides meet."""
    start = np.searchsorted(group, group, side="left")
    held_i, held_j, size, d = [], [], 0, 1
    live = np.arange(len(group)) if later is None else np.flatnonzero(later)
    live = live[live > start[live]]
    while len(live):
        i, j = live - d, live
        meets = (side[i] != side[j]) | (side[i] < 0)
        held_i.append(i[meets])
        held_j.append(j[meets])
        size += len(held_i[-1])
        if size >= AT_ONCE:
            yield np.concatenate(held_i), np.concatenate(held_j)
            held_i, held_j, size = [], [], 0
        d += 1
        live = live[live - d >= start[live]]
    if size:
        yield np.concatenate(held_i), np.concatenate(held_j)


def _shared_before(group: np.ndarray, tops: np.ndarray, triple: np.ndarray) -> np.ndarray:
    """Of each row whether it holds the pivot that most rows of its list hold besides the list's own and before the last of these.

    Two rows that both hold it meet in an earlier list already. In a list of copies that is nearly all of them, so nearly no pair of theirs is tried twice.
    """
    own = np.stack([(triple >> (12 * k)) & 4095 for k in range(SHARED)], 1)
    before = (tops < own.max(1)[:, None]) & (tops[:, :, None] != own[:, None, :]).all(2)
    row, col = np.nonzero(before)
    out = np.zeros(len(group), bool)
    if not len(row):
        return out
    key = group[row] * 4096 + tops[row, col]
    keys, at, count = np.unique(key, return_inverse=True, return_counts=True)
    order = np.lexsort((count, keys // 4096))
    last = np.concatenate([keys[order][1:] // 4096 != keys[order][:-1] // 4096, [True]])
    most = np.zeros(len(keys), bool)
    most[order[last]] = True
    out[row[most[at]]] = True
    return out


def _compare(table: pa.Table, least: float) -> Iterator[pa.RecordBatch]:
    """Links of whole groups, rows sorted by (key, b1, b2)."""
    if not table.num_rows:
        return
    key, b1, b2, own = (table[c].to_numpy() for c in ("key", "b1", "b2", "own"))
    change = np.concatenate([[False], (key[1:] != key[:-1]) | (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1])])
    group = np.cumsum(change)
    tops, triple = matrix(table["tops"]).astype(np.int64), table["triple"].to_numpy()
    known = _shared_before(group, tops, triple) if tops.shape[1] > SHARED else np.zeros(len(group), bool)
    order = np.lexsort((~known, group))  # those first; only pairs with another row are tried
    group, known, b1, b2, own, tops, triple = (x[order] for x in (group, known, b1, b2, own, tops, triple))
    side = np.where(b1 == b2, -1, (own == b2).astype(int))
    node, n, vec = table["node"].to_numpy()[order], table["n"].to_numpy()[order], matrix(table["v"])[order]
    norm = dots(vec, vec)
    for i, j in pairs_of_sorted(group, side, ~known):
        for at in range(0, len(i), AT_ONCE):
            a, b = i[at : at + AT_ONCE], j[at : at + AT_ONCE]
            a, b = a[node[a] != node[b]], b[node[a] != node[b]]
            both = (tops[a][:, :, None] == tops[b][:, None, :]).any(2)
            place = np.cumsum(both, 1)
            first = np.zeros(len(a), np.int64)
            for k in range(min(SHARED, tops.shape[1])):
                first += (tops[a] * (both & (place == k + 1))).sum(1) << (12 * k)
            a, b = a[first == triple[a]], b[first == triple[a]]
            linked = dots(vec[a], vec[b]) / np.sqrt(norm[a] * norm[b]) >= least
            a, b = a[linked], b[linked]
            if len(a):
                yield pa.record_batch({"a": node[a], "b": node[b], "n_a": n[a], "n_b": n[b]})


def near_duplicates(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: vec_id, n_links (other rows of the same label at a cosine of `least` or more, as found), component_id (smallest id reachable) and kept.

    Rows whose vector is null, zero or has null or non-finite components, or whose label is null, link with nothing. Equal vectors of a
    label are one node with a count, each other's links. A null id is passed over as smallest id; kept is whether the row's id is the
    component's, or both are null. Vectors of different lengths aren't compared. Other columns are ignored.
    """
    workers_can_import(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).cast("string").alias("label"))
    rows = rows.withColumn("node", F.when(usable("v") & F.col("label").isNotNull(), F.xxhash64("label", "v")))
    nodes = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.min_by("label", "node").alias("label"), F.min_by("v", "node").alias("v"))
    nodes = cut(nodes)
    pivots: dict[int, np.ndarray] = {}
    for dim, rows_of in nodes.groupBy(F.size("v")).count().collect():
        # the least hashes, without sorting more than those that can be among them
        share = min(1.0, 1.5 * SAMPLE / rows_of)
        near = nodes.where(F.size("v") == dim).select("v", F.xxhash64("node").alias("h")).where(F.col("h") < F.lit(int(share * 2**64) - 2**63 - (share == 1.0)))
        x = np.array([r.v for r in near.orderBy("h").limit(SAMPLE).collect()], np.float64)
        most = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, PIVOTS_A_ROOT * rows_of**0.5)))
        pivots[dim] = spread((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32), most)
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS x length x 4 bytes for each length

    @F.pandas_udf(ArrayType(ShortType()))
    def nearest(v: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in v:
            out: list = [None] * len(s)
            dims = s.map(len).to_numpy() if len(s) else np.zeros(0, int)
            for d in np.unique(dims):
                at, p = np.flatnonzero(dims == d), shared.value[int(d)]
                x = np.stack([np.asarray(s.iloc[i], np.float64) for i in at])
                x = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)
                near = x @ p.T
                top = np.argpartition(near, -NEAREST, axis=1)[:, -NEAREST:] if len(p) > NEAREST else np.broadcast_to(np.arange(len(p)), near.shape)
                top = np.sort(top, axis=1).astype(np.int16)
                for i, t in zip(at, top):
                    out[i] = t
            yield pd.Series(out, index=s.index, dtype=object)

    @F.pandas_udf(ArrayType(LongType()))
    def triples(tops: pd.Series) -> pd.Series:
        size, out = tops.map(len).to_numpy(), np.empty(len(tops), object)
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            for i, t in zip(at, _triples(np.stack([tops.iloc[i] for i in at]))):
                out[i] = t
        return pd.Series(list(out), index=tops.index, dtype=object)

    described = cut(nodes.select("node", "n", "first", "label", "v", nearest("v").alias("tops")))
    listed = described.select("node", "label", F.size("v").alias("dim"), F.explode(triples("tops")).alias("triple")).select("node", "triple", F.xxhash64("label", "dim", "triple").alias("key"))
    # most sets are one vector's alone; only the others go on, and only they carry vectors
    live = listed.withColumn("length", F.count("*").over(Window.partitionBy("key"))).where("length > 1").withColumn("blocks", F.ceil(F.col("length") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    live = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", "key", "triple", "own", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"))
    full = live.join(described.select("node", "n", "v", "tops"), "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> Iterator[pa.RecordBatch]:
            rest: pa.Table | None = None
            for b in batches:
                t = pa.Table.from_batches([b])
                t = pa.concat_tables([rest, t]) if rest is not None else t
                if t.num_rows:
                    k = [t[c].to_numpy() for c in ("key", "b1", "b2")]
                    last = np.logical_and.reduce([x == x[-1] for x in k])
                    whole = int(np.argmax(last))  # rows before the last group
                    yield from _compare(t.slice(0, whole), least)
                    rest = t.slice(whole)
            if rest is not None:
                yield from _compare(rest, least)

        yield from fold_links(links())

    cells = full.select("key", "b1", "b2", "own", "node", "n", "triple", "tops", "v").repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2")
    folded = cut(cells.mapInArrow(compare, FOLDED))
    links = folded.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(folded.where("links is null").select(F.col("node").alias("src"), F.col("root").alias("dst")))
    classes = described.select("node", "n", "first").join(links, "node", "left").join(components, "node", "left").select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "first", F.coalesce("component", "node").alias("component"))
    smallest = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = classes.join(smallest, "component").select("node", "n_links", "component_id")
    alone = rows.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.where("node is not null").join(classes, "node").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
