import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corvane.llm import components, joins, simhash
from corvane.llm.components import connected_components, spanning_forest
from corvane.llm.simhash import drop_near_duplicates, fingerprint, near_duplicates


def slow_fingerprint(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and (fps[i] ^ fps[j]).bit_count() <= 4] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], f"{fps[i]:016x}", len(near[i]), min(ids) if ids else None))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    assert sorted(map(tuple, near_duplicates(df).collect()), key=key) == sorted(slow(rows), key=key)


def test_fingerprint_of_odd_texts():
    rng = np.random.default_rng(1)
    words = ["Ab", "É", " x", "İ", "\x1cq", "tiger", " "]
    for _ in range(200):
        t = "".join(rng.choice(words) + rng.choice([" ", "\t", "\x0b", "  ", "\n"]) for _ in range(rng.integers(0, 30)))
        assert fingerprint(t) == slow_fingerprint(t)
    assert fingerprint(None) == fingerprint("") == fingerprint(" \n") == 0


def test_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    long = " ".join(f"w{i}" for i in range(30_000))
    rows += [(9001, None), (9002, ""), (9003, "one"), (9004, "One"), (9005, "one"), (None, "one"), (9005, "one"), (9006, long), (9007, long + " end")]
    # chains of texts that differ a little, so that components are wider than links
    base = [f"t{i}" for i in range(400)]
    for k in range(40):
        base[(k * 7) % 400] = f"new{k}"
        rows.append((10_000 - k, " ".join(base)))
    check(spark, rows)


def test_empty_table(spark):
    check(spark, [])
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).columns == ["doc_id", "fingerprint", "n_near", "component_id"]


@pytest.mark.parametrize("hot", [4096, 6])
def test_links_of_chosen_fingerprints(spark, monkeypatch, hot):
    """Every pair at 0 to 6 bits, over all splits of the bits between segments; with hot variants cut into blocks and without."""
    from corvane.llm import simhash

    monkeypatch.setattr(simhash, "HOT", hot)

    rng = np.random.default_rng(2)
    fps = {int(x) for x in rng.integers(0, 2**63, 40)}
    for x in list(fps):
        for k in range(1, 7):
            y = x
            for b in rng.choice(64, k, replace=False):
                y ^= 1 << int(b)
            fps.add(y)
    fps = [x - 2**64 if x >= 2**63 else x for x in fps]
    df = spark.createDataFrame([(x, 1, i) for i, x in enumerate(fps)], "fp long, n long, first long")
    assert simhash.hot_variants(df).isEmpty() == (hot > len(fps))
    got = {r.fp: r.links for r in simhash.link(df).collect()}
    want = {x: sum(((x ^ y) & (2**64 - 1)).bit_count() <= 4 for y in fps if y != x) for x in fps}
    assert got == {k: v for k, v in want.items() if v}


def test_components_against_union_find(spark):
    rng = np.random.default_rng(3)
    n = 300
    edges = [(int(a), int(b)) for a, b in rng.integers(0, n, (220, 2))] + [(i, i + 1) for i in range(1000, 1080)]
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges + [(5, 5), (None, 3)], "src long, dst long")).collect()}
    alone = {x for x in label if all(x not in e or e[0] == e[1] for e in edges)}
    assert got == {k: v for k, v in label.items() if k not in alone}
    a, b = spanning_forest(*map(np.array, zip(*edges)))
    assert {int(x): int(y) for x, y in zip(a, b)} == {k: v for k, v in label.items() if k != v}


def test_one_row_of_each_component_stays(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").selectExpr("*", "'c' as fp", "1 as h")
    odd = [(None, None, "c", 1), (None, "", "c", 1), (7000, "alone and here", "c", 1), (7000, "alone and here", "c", 1), (7000, "quite another text of its own", "c", 1), (7001, "alone and here", "c", 1), (None, "null id by itself stays", "c", 1)]
    df = docs.union(spark.createDataFrame(odd, docs.schema))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    fps = [slow_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    out = drop_near_duplicates(df)
    assert out.columns == df.columns
    got = out.collect()
    assert len(got) == len(set(label))
    best = {}
    for (i, t), c in zip(rows, label):
        best[c] = min(best.get(c, (True, 0)), (i is None, i or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(best.values())
    assert drop_near_duplicates(df.limit(0)).count() == 0


def test_many_dropped_documents_are_joined_by_a_shuffle(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.union(docs.limit(40)).selectExpr("*", "'x' as h")
    want = sorted(map(str, simhash.drop_near_duplicates(docs).collect()))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(simhash, "HOT", 4)
    monkeypatch.setattr(components, "WHOLE_LINKS", 0)
    assert sorted(map(str, simhash.drop_near_duplicates(docs).collect())) == want
    assert len(want) < docs.count()


@pytest.mark.parametrize("make, limit", [(lambda i: f"{i:04d}" + "x" * 1000, 30_000), (lambda i: i, 8_000)])
def test_long_ids_count_when_the_dropped_documents_are_broadcast(spark, monkeypatch, make, limit):
    """100 rows go: 64 bytes a row would be under the limit, what they take in the driver's hash table isn't."""
    texts = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(50)]
    df = spark.createDataFrame([(make(3 * i + k), t) for i, t in enumerate(texts) for k in range(3)], f"doc_id {'string' if limit == 30_000 else 'long'}, text string")

    def joins_of(out):
        return re.findall("BroadcastHashJoin|SortMergeJoin", out._jdf.queryExecution().executedPlan().toString())

    small = drop_near_duplicates(df)
    assert joins_of(small) == ["BroadcastHashJoin"]
    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    large = drop_near_duplicates(df)
    assert joins_of(large) == ["SortMergeJoin"]
    assert sorted(large.collect()) == sorted(small.collect()) == sorted((make(3 * i), t) for i, t in enumerate(texts))


def test_variants_are_never_broadcast(spark):
    """However small Spark takes them to be: by AQE, fingerprints just under the threshold would be broadcast 64 times over."""
    few = spark.createDataFrame([(x, 1) for x in range(5)], "fp long, n long").repartition(2, "fp")
    v = few.select(F.explode(simhash.variants(F.col("fp"))).alias("key"), "fp", "n")
    for left, on in ((v, ("key",)), (v.withColumn("x", F.lit(0)), ("key", "x"))):
        met = simhash._meet(left, left, on, F.col("a") < F.col("b"))
        assert {(r.a, r.b) for r in met.collect()} == {(a, b) for a in range(5) for b in range(a + 1, 5)}
        assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
