import math
import random
import re
import weakref
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane import embed
from corvane.operators import catalogue, evaluation, maintenance, search


def ranked(spark, keys):
    return spark.createDataFrame([(k, i + 1) for i, k in enumerate(keys)], "chunk_key string, rank int")


def fuse(a, b, k):
    score = {}
    for keys, w in ((a, 0.4), (b, 0.6)):
        for i, key in enumerate(keys):
            score[key] = score.get(key, 0) + w / (61 + i)
    order = list(dict.fromkeys([*a, *b]))
    return sorted(order, key=lambda x: -score[x])[:k]


def test_fusion(spark):
    got = [r.chunk_key for r in search.rrf(ranked(spark, "abc"), ranked(spark, "bdc"), 10).collect()]
    assert got == fuse("abc", "bdc", 10) and set(got[:2]) == {"b", "c"} and len(got) == 4
    assert search.rrf(ranked(spark, "abcdef"), ranked(spark, "ghi"), 2).count() == 2
    assert [r.chunk_key for r in search.rrf(ranked(spark, ""), ranked(spark, "xyz"), 5).collect()] == list("xyz")
    assert [r.chunk_key for r in search.rrf(ranked(spark, "xyz"), ranked(spark, ""), 5).collect()] == list("xyz")
    assert search.rrf(ranked(spark, ""), ranked(spark, ""), 5).count() == 0
    tie = search.rrf(ranked(spark, ["p", "t"]), ranked(spark, [f"v{i}" for i in range(32)] + ["s"]), 50).collect()
    at = {r.chunk_key: i for i, r in enumerate(tie)}
    assert at["t"] < at["s"] and {r.chunk_key: r.score for r in tie}["t"] == {r.chunk_key: r.score for r in tie}["s"]


@settings(max_examples=8, deadline=None)
@given(st.permutations("abcdefgh"), st.permutations("efghijkl"), st.integers(1, 9))
def test_fusion_as_plain_python(spark, a, b, k):
    got = [r.chunk_key for r in search.rrf(ranked(spark, a), ranked(spark, b), k).collect()]
    assert got == fuse(a, b, k)


CHUNK = "codebase_id long, chunk_key string, name string, signature string, embedding array<float>"


def test_keyword_search_is_scoped_to_a_codebase(spark):
    rows = [(1, "a", "open_file", "def open_file(path)", None), (1, "b", "close", "def close(file)", None), (1, "c", "", "", None), (2, "d", "file", "fn file()", None), (2, "e", "other", "x", None)]
    df = spark.createDataFrame(rows, CHUNK)
    top = search.keyword_topk(df, ["file"], 10).collect()
    assert {r.chunk_key for r in top} == {"a", "b", "d"} and top[0].score >= top[-1].score > 0
    assert search.keyword_topk(df, ["nothing"], 3).count() == 0 == search.keyword_topk(df, [], 3).count()
    q = spark.createDataFrame([(0, "file"), (1, "close")], "query_id int, query string")
    bulk = search.keyword_topk_bulk(search.postings(df), search.field_stats(search.postings(df), df), q, 10).collect()
    assert {(r.chunk_key, round(r.score, 6)) for r in bulk if r.query_id == 0} == {(r.chunk_key, round(r.score, 6)) for r in top}


def test_vector_search(spark):
    random.seed(1)
    rows = [(1, f"k{i:02}", "", "", [random.gauss(0, 1) for _ in range(8)]) for i in range(40)] + [(1, "none", "", "", None), (2, "k05b", "", "", None)]
    df = spark.createDataFrame(rows, CHUNK)
    q = rows[5][4]
    top = search.vector_topk(df, q, 3).collect()
    assert top[0].chunk_key == "k05" and abs(top[0].score - 1) < 1e-6 and len(top) == 3
    plan = search.vector_topk(df, q, 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert search.over_threshold(search.vector_topk(df, q, 3), 0.99).count() == 1 and search.over_threshold(search.vector_topk(df, q, 3), 0).count() == 3


def test_catalogue(spark):
    c = spark.createDataFrame([(1, "/a", "a", 0), (2, "/a/b", "b", 0)], "id long, root_path string, name string, indexed_at long")
    f = spark.createDataFrame([(1, "/a/x", "h", 2), (1, "/a/y", "h", 3)], "codebase_id long, file_path string, file_hash string, chunk_count int")
    assert [tuple(r)[-2:] for r in catalogue.list_codebases(c, f).collect()] == [(2, 5), (0, 0)]
    assert catalogue.current_codebase(c, "/a/b/c").first().id == 2 and catalogue.current_codebase(c, "/a/bc").first().id == 1
    assert catalogue.current_codebase(c, "/ab").first() is None
    e = spark.createDataFrame([(1, None, "m"), (1, [1.0], "m"), (1, [1.0], "old")], "codebase_id long, embedding array<float>, embedding_model string")
    assert catalogue.stale(e, "m").count() == 2 == catalogue.stale(e, "m", 0).count() and catalogue.stale(e, "m", 1).count() == 1


def test_maintenance(spark):
    s = "codebase_id long, file_path string, file_hash string"
    scan = spark.createDataFrame([(1, "a", "1"), (1, "b", "2x"), (1, "n", "9")], s)
    state = spark.createDataFrame([(1, "a", "1"), (1, "b", "2"), (1, "g", "3")], s)
    assert {r.file_path: r.status for r in maintenance.hash_diff(scan, state).collect()} == {"a": "unchanged", "b": "changed", "n": "added", "g": "removed"}
    assert {r.file_path for r in maintenance.changed(scan, state).collect()} == {"b", "n"}
    assert [r.file_path for r in maintenance.gone(state, scan).collect()] == ["g"]
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("m", 1, "x")], "key string, n int, v string")
    assert {r.key: r.v for r in maintenance.last_wins(rows, ("key",), "n").collect()} == {"k": "new", "m": "x"}


def test_upsert_takes_over_and_drops_the_embedding(spark):
    stored = spark.createDataFrame([(1, "/a/f", "k", "s", [1.0], "m"), (1, "/a/g", "j", "s", [1.0], "m")], "codebase_id long, file_path string, chunk_key string, snippet string, embedding array<float>, embedding_model string")
    new = spark.createDataFrame([(2, "/other", "k", "one", 0), (2, "/other", "k", "two", 1)], "codebase_id long, file_path string, chunk_key string, snippet string, seq int")
    got = {r.chunk_key: r for r in maintenance.upsert_chunks(stored, new, "seq").collect()}
    assert tuple(got["k"]) == (2, "/a/f", "k", "two", None, "") and got["j"].embedding == [1.0]


def test_evaluation(spark):
    q = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "query_id int, category string")
    r = spark.createDataFrame([(1, 1, True), (1, 2, True), (2, 1, False), (2, 4, True)], "query_id int, rank int, hit boolean")
    first = evaluation.first_hits(r, q)
    all_ = evaluation.quality(first).first()
    assert (all_.n, all_.top1, all_.top3, all_.top5) == (3, 1 / 3, 1 / 3, 2 / 3) and abs(all_.mrr - (1 + 0.25) / 3) < 1e-12
    by = {r.category: r.n for r in evaluation.quality(first, ("category",), total=True).collect()}
    assert by == {"x": 2, "y": 1, None: 3}
    t = {r.query_id: (r.a, r.b) for r in first.select("query_id", evaluation.tier(F.col("first")).alias("a"), evaluation.tier(F.col("first"), False).alias("b")).collect()}
    assert t == {1: (3, 3), 2: (1, 0), 3: (0, 0)}
    h = first.agg(*evaluation.head_to_head(evaluation.tier(F.col("first")), F.lit(1))).first()
    assert tuple(h) == (1, 1, 1)
    d = spark.createDataFrame([("a", "foo bar"), ("b", "bar"), ("c", None)], "k string, t string")
    assert [tuple(x) for x in evaluation.pattern_counts(d, "k", "t", ["foo", "bar", "^b"]).collect()] == [("a", 2), ("b", 2)]
    e = spark.createDataFrame([("/x/a.rs", "parse_all", ["a.rs"], None), ("/x/b.rs", "parse_all", ["a.rs"], ["parse"]), ("/x/b.rs", "n", ["a.rs"], ["parse"])], "p string, n string, f array<string>, m array<string>")
    assert [x[0] for x in e.select(evaluation.is_hit(*map(F.col, "pnfm"))).collect()] == [True, True, False]


def test_hashing_embedder_against_a_slow_version(spark):
    texts = ["def retry(times): sleep 2", "", "a a a", "Ünïcode retry_times 42", "x" * 200]

    def slow(text):
        v = [0.0] * embed.DIM
        for t in dict.fromkeys(re.findall("[a-z0-9]+", text.lower())):
            edged = f"^{t}$"
            for g, w in [(t, 2.0), *[(edged[k : k + 3], 0.5) for k in range(len(t))]]:
                h = zlib.crc32(g.encode())
                v[h % embed.DIM] += w if h >= 1 << 31 else -w
        n = math.sqrt(sum(x * x for x in v))
        return [x / n if n else 0.0 for x in v]

    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.v for r in df.select("i", embed.embedding(embed.hashing_embedder, F.col("text")).alias("v")).collect()}
    assert all(max(abs(a - b) for a, b in zip(got[i], slow(t))) < 1e-6 for i, t in enumerate(texts))


def test_longest_root_of_each_path(spark):
    roots = ["/a", "/a/b", "/a/b/c d", "", "/x"]
    paths = ["/a", "/a/b", "/a/bc", "/a/b/c d/e", "/y", "/x/", None, "/a", "no/slash"]
    got = catalogue.codebase_of(spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "k int, p string"), "p", spark.createDataFrame([(r,) for r in roots], "root_path string"))
    want = {k: max((r for r in roots if p == r or p.startswith(r + "/")), key=len, default=None) for k, p in enumerate(paths) if p is not None}
    assert {r.k: r.root_path for r in got.collect()} == {k: r for k, r in want.items() if r is not None}


def test_bulk_nearest_with_many_ties(spark):
    rows = [(k, [1.0, 0.0] if k % 3 else [0.0, 1.0]) for k in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.where("vec_id in (0, 1)").selectExpr("vec_id as query_id", "embedding as query")
    got = search.vector_topk_bulk(q, v, 4, other_than_itself=True).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 3), (0, 2, 6), (0, 3, 9), (0, 4, 12), (1, 1, 2), (1, 2, 4), (1, 3, 5), (1, 4, 7)]
    assert len(search.vector_topk_bulk(q, v.limit(3), 10).collect()) == 6


def test_a_stored_query_reads_only_its_terms(spark, tmp_path):
    df = spark.createDataFrame([(1, str(k), f"name{k} common", f"sig {k}") for k in range(50)], "codebase_id long, chunk_key string, name string, signature string")
    index = search.postings(df)
    index.sortWithinPartitions("term").write.parquet(f"{tmp_path}/postings")
    stored, stats = spark.read.parquet(f"{tmp_path}/postings"), search.field_stats(index, df)
    found = search.keyword_topk_stored(stored, stats, ["name7", "common"], 3)
    assert "PushedFilters: [In(term, [common,name7])" in found._jdf.queryExecution().executedPlan().toString().replace("IsNotNull(term), ", "")
    want = search.keyword_topk(df, ["name7", "common"], 3).collect()
    assert [(r.chunk_key, round(r.score, 6)) for r in found.orderBy("rank").collect()] == [(r.chunk_key, round(r.score, 6)) for r in want]


def test_bulk_nearest_in_strips(spark, monkeypatch):
    """A strip of a cell's queries is scored at a time, with the same result, ties included."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id % 3 = 0").selectExpr("vec_id as query_id", "embedding as query")
    unit = np.array([x for _, x in rows])
    length = np.sqrt((unit * unit).sum(1))
    with np.errstate(invalid="ignore"):
        s = np.round(np.nan_to_num(unit @ unit.T / np.outer(length, length)), 9)
    want = {(i, j, r + 1) for i in range(0, 60, 3) for r, j in enumerate(sorted(set(range(60)) - {i}, key=lambda j: (-s[i, j], j))[:4])}
    for strip in (1, 7, 128):
        monkeypatch.setattr(search, "STRIP", strip)
        assert {(r.query_id, r.vec_id, r.rank) for r in search.vector_topk_bulk(q, v, 4, other_than_itself=True).collect()} == want


def test_postings_are_counted_where_the_rows_are(spark):
    """No row of a term is shuffled; only rows that share a key are, and add up by length."""
    rows = [(i % 2, f"k{i}", None if i == 3 else f"one two{i % 3}", "b a b " * (i % 4)) for i in range(12)]
    df = spark.createDataFrame(rows, "codebase_id long, chunk_key string, name string, signature string")
    twice = df.union(df.where("chunk_key in ('k1', 'k2')")).union(spark.createDataFrame([(0, "k2", "one", "b"), (None, None, "x", "x")], df.schema))
    assert "Exchange" not in search.postings(df)._jdf.queryExecution().executedPlan().toString()
    for table in (df, twice):
        want = Counter()
        for r in table.collect():
            for f in search.FIELDS:
                t = re.findall("[a-z0-9]+", (r[f] or "").lower())
                want.update((r.codebase_id, r.chunk_key, f, x, len(t)) for x in t)
        got = search.postings(table).collect()
        assert {(r.codebase_id, r.chunk_key, r.field, r.term, r.dl): r.tf for r in got} == want and len(got) == len(want)


def test_an_embedders_lists_are_let_go(monkeypatch):
    """Of a batch only one call's lists are held: as Python numbers they take eight times their vectors."""

    class Vector(list):
        __hash__, __eq__ = object.__hash__, object.__eq__

    alive, most, made = weakref.WeakSet(), [], []

    def embedder(texts):
        most.append(len(alive))
        out = [Vector([float(len(t)), float(k)]) for k, t in enumerate(texts)]
        alive.update(out)
        return out

    monkeypatch.setattr(embed.F, "arrow_udf", lambda kind: lambda f: lambda text: made.append(f))
    embed.embedding(embedder, None)
    texts = [None if i % 7 == 0 else "x" * (i % 7) for i in range(1000)]
    (out,) = made[0](iter([pa.array(texts)]))
    assert out.to_pylist() == [[float(len(t or "")), float(i % embed.BATCH)] for i, t in enumerate(texts)]
    assert max(most) <= 2 * embed.BATCH
