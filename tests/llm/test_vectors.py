import numpy as np
import pytest

from corvane.llm import ann, embed_dedup
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, score string, node int"


def rows_with_clusters(spark, seed=6, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(500):
        x = rng.normal(size=dim)
        for _ in range(1 if k % 5 else int(rng.integers(2, 9))):
            rows.append([len(rows), (x + rng.normal(size=dim) * rng.choice([0, 0.05, 0.2])).astype("f4").tolist(), int(rng.integers(0, 3)) if k % 10 else 1])
    hot = rng.normal(size=dim)
    for _ in range(250):
        rows.append([len(rows), (hot + rng.normal(size=dim) * 0.12).astype("f4").tolist(), 2])
    nan, inf = float("nan"), float("inf")
    odd = [None, [0.0] * dim, [nan] + [1.0] * (dim - 1), [inf] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [], [1.0, 2.0], [1.0, 2.0]]
    rows += [[5000 + 25 * i, v, 1] for i, v in enumerate(odd)]
    rows += [[None, rows[0][1], 1], [10, rows[10][1], rows[10][2]], [10, rows[10][1], rows[10][2]], [50, rows[7][1], 0], [6000, rows[3][1], None]]
    return [(*r, "clash", 1) for r in rows]


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def slow_nearest(rows, k):
    ok = [(r[0], np.array(r[1], float)) for r in rows if r[0] is not None and fine(r[1])]
    out, seen = [], set()
    for n, (i, q) in enumerate(ok):
        if i % 50 or (i, q.tobytes()) in seen:
            continue
        seen.add((i, q.tobytes()))
        best = sorted((-round(cosine(q, c), 9), j) for m, (j, c) in enumerate(ok) if m != n and len(c) == len(q))[:k]
        out += [(i, rank + 1, j, round(-s, 6)) for rank, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("tile", [2048, 64])
def test_nearest_against_brute_force(spark, monkeypatch, tile):
    rows = rows_with_clusters(spark)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 5)
    monkeypatch.setattr(ann, "CANDIDATE_BLOCK", 300)
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    want = slow_nearest(rows, 5)
    assert sorted((r[0], r[1], r[2], round(r[3], 6)) for r in got.collect()) == want
    assert ann.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(50, 64)), rng.normal(size=(80, 64)) * 1e-3
    got, off = ann.bounds(ann.codes(a), ann.codes(b))
    true = np.array([[cosine(x, y) for y in b] for x in a])
    assert (abs(got - true) <= off).all() and off.max() < 0.1


def slow_links(rows):
    near = []
    for n, r in enumerate(rows):
        own = []
        for m, s in enumerate(rows):
            if m != n and r[2] is not None and r[2] == s[2] and fine(r[1]) and fine(s[1]) and len(r[1]) == len(s[1]) and cosine(np.array(r[1], float), np.array(s[1], float)) >= 0.93:
                own.append(m)
        near.append(own)
    out = []
    for n in range(len(rows)):
        seen, todo = {n}, [n]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        ids = [rows[m][0] for m in seen if rows[m][0] is not None]
        c = min(ids) if ids else None
        out.append((rows[n][0], len(near[n]), c, rows[n][0] == c))
    return out, near


def test_links_and_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 40)
    rows = rows_with_clusters(spark)
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = got.collect()
    want, near = slow_links(rows)
    found, true = sum(r.n_links for r in got), sum(map(len, near))
    assert len(got) == len(rows) and true * 0.97 <= found <= true
    key = lambda r: tuple(map(str, r))
    differ = sum(a != b for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)))
    assert found == true and differ == 0 or differ < 0.05 * len(rows)
    assert embed_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_all_links_where_pivots_are_all_vectors(spark):
    rows = [(i, [float(i % 3), 1.0, 0.5 * (i % 2)], 0, "x", 1) for i in range(7)] + [(9, [1.0], 1, "x", 1)]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(slow_links(rows)[0])


def test_pairs_of_sorted():
    group, side = np.array([0, 0, 0, 1, 2, 2, 2, 2]), np.array([-1, -1, -1, -1, 0, 1, 1, 0])
    got = sorted((int(a), int(b)) for i, j in embed_dedup.pairs_of_sorted(group, side) for a, b in zip(i, j))
    assert got == [(0, 1), (0, 2), (1, 2), (4, 5), (4, 6), (5, 7), (6, 7)]


def test_recall_at_the_threshold(spark):
    """Pairs at cosines just over 0.93 among vectors of 64 components, and a dense group: at least nine of ten links are found."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 64))
    z = rng.normal(size=x.shape)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = rng.uniform(0.9301, 0.95, (len(x), 1))
    near = c * x + np.sqrt(1 - c * c) * z
    group = x[0] + rng.normal(size=(300, 64)) * 0.025
    v = np.concatenate([x, near, group])
    rows = [(i, y.tolist(), 0, "s", 1) for i, y in enumerate(v)]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    true = int((unit @ unit.T >= 0.93).sum()) - len(v)
    found = sum(r.n_links for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert 0.9 * true <= found <= true + 2
