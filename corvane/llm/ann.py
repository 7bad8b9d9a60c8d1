"""Nearest neighbours by a block matrix join.

Queries and candidates are cut into blocks, and each pair of blocks meets once in a grid cell of bounded size. There, vectors
are rounded to int8 codes whose rounding errors are known; tile by tile, the product of the codes gives every cosine
within a bound. Candidates whose upper bound lies below the k-th largest lower bound of a query are out; the
others are computed again in double precision. A heap per query keeps the cell's k best; these are merged over the cells.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.vectors import dots, matrix, usable
from corvane.session import workers_can_import

#: Queries and candidates of a cell, on average, and candidates of a tile.
QUERY_BLOCK, CANDIDATE_BLOCK, TILE = 2048, 8192, 2048
#: More than the rounding of the bounds' own arithmetic.
SLACK = 1e-6


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and error norms of vectors, each divided by its length."""
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    scale = np.abs(unit).max(1, keepdims=True) / 127
    q = np.rint(unit / scale).astype(np.int8)
    return q, scale[:, 0], np.sqrt(((unit - scale * q) ** 2).sum(1))


def bounds(q: tuple, c: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Cosines from codes, and how far they may be off."""
    kind = np.float32 if q[0].shape[1] * 127 * 127 < 1 << 24 else np.float64  # either holds every sum of products exactly
    product = (q[0].astype(kind) @ c[0].astype(kind).T).astype(np.float64) * q[1][:, None] * c[1][None, :]
    return product, q[2][:, None] + c[2][None, :] * (1 + q[2][:, None]) + SLACK


def cell(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, times: np.ndarray, same: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score) of each query's k best here. same: by query, the candidate row that is the query itself, or -1."""
    nq = len(qid)
    qc, qn = codes(q), dots(q, q)
    cn = dots(c, c)
    floor = np.full(nq, -np.inf)
    heaps: list[list] = [[] for _ in range(nq)]
    for at in range(0, len(cid), TILE):
        tile = slice(at, at + TILE)
        cosine, off = bounds(qc, codes(c[tile]))
        own = (same >= at) & (same < at + TILE) & (times[np.maximum(same, 0)] == 1)
        cosine[own, same[own] - at] = -np.inf
        if cosine.shape[1] >= k:
            floor = np.maximum(floor, np.partition(cosine - off, -k, axis=1)[:, -k])
        row, col = np.nonzero(cosine + off >= floor[:, None])
        col += at
        ok = np.isfinite(cosine[row, col - at])
        row, col = row[ok], col[ok]
        score = np.clip(dots(q[row], c[col]) / np.sqrt(qn[row] * cn[col]), -1, 1)
        copies = times[col] - (same[row] == col)
        for r, s, i, n in zip(row.tolist(), score.tolist(), cid[col].tolist(), copies.tolist()):
            heap = heaps[r]
            for _ in range(min(n, k)):
                if len(heap) < k:
                    heapq.heappush(heap, (s, -i))
                elif (s, -i) > heap[0]:
                    heapq.heapreplace(heap, (s, -i))
        floor = np.maximum(floor, [h[0][0] - SLACK if len(h) == k else -np.inf for h in heaps])
    out = [(r, -i, s) for r, h in enumerate(heaps) for s, i in h]
    return tuple(map(np.array, zip(*out))) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `vectors` where `queries` holds the k other rows at the largest cosine.

    All rows are candidates; a row isn't its own candidate, but equal rows are each other's. Ties go to the smaller id. Vectors that are
    null, zero or have null or non-finite components, and rows without an id, take no part; vectors of another length aren't
    compared. Rows equal in id and vector are one query. Fewer than k candidates: all of them. Other columns are ignored.
    """
    workers_can_import(vectors.sparkSession)
    query = "__query"
    v = vectors.withColumn(query, F.coalesce(queries, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), query).where(F.col("id").isNotNull() & usable("v"))
    # equal rows become one with a count, so blocks by hash are even whatever repeats
    v = v.groupBy("id", "v").agg(F.count("*").alias("times"), F.max(query).alias(query)).withColumn("h", F.xxhash64("id", "v"))
    n = v.agg(F.count("*"), F.coalesce(F.sum(F.col(query).cast("int")), F.lit(0))).first()
    rows, cols = max(1, -(-n[1] // QUERY_BLOCK)), max(1, -(-n[0] // CANDIDATE_BLOCK))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dim = F.size("v").alias("dim")
    q = v.where(query).select("id", "v", "h", dim, F.pmod("h", F.lit(rows)).cast("int").alias("r"), every(cols).alias("c"))
    c = v.select("id", "v", "h", "times", dim, F.pmod("h", F.lit(cols)).cast("int").alias("c"), every(rows).alias("r"))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        qid, qh, cid = a["id"].to_numpy(), a["h"].to_numpy(), b["id"].to_numpy()
        where = {key: i for i, key in enumerate(zip(cid.tolist(), b["h"].to_pylist()))}
        same = np.array([where.get(key, -1) for key in zip(qid.tolist(), qh.tolist())])
        row, vec, score = cell(qid, matrix(a["v"]), cid, matrix(b["v"]), b["times"].to_numpy(), same, k)
        return pa.table([qid[row], qh[row], vec.astype(np.int64), score], schema=schema)

    found = q.groupBy("r", "c", "dim").cogroup(c.groupBy("r", "c", "dim")).applyInArrow(best, "query_id long, query long, vec_id long, score double")
    rank = F.expr("row_number() over (partition by query_id, query order by score desc, vec_id)")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
