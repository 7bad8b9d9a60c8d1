import heapq
from fractions import Fraction
from math import ceil, floor

import numpy as np
import pyarrow.parquet as pq
import pytest

from corvane.llm import mixing


def test_period_keeps_releases_deadlines_and_lag():
    rng = np.random.default_rng(5)
    for _ in range(60):
        units = [int(x) for x in rng.integers(1, 40, rng.integers(1, 12))]
        order, n = mixing.period(units), sum(units)
        took = [0] * len(units)
        for slot, i in enumerate(order):
            assert floor(took[i] * n / units[i]) <= slot < ceil((took[i] + 1) * n / units[i])
            took[i] += 1
            assert all(abs(t - u * (slot + 1) / n) < 1 for t, u in zip(took, units))
        assert took == units


def slow(units, blocks):
    """(source, block) by slot, in fractions, slot by slot."""
    fluid = lambda v: sum(min(Fraction(int(u)) * v, int(n)) for u, n in zip(units, blocks))
    jobs = sorted((floor(fluid(Fraction(i, int(u)))), ceil(fluid(Fraction(i + 1, int(u)))), s, i) for s, (u, n) in enumerate(zip(units, blocks)) for i in range(int(n)))
    ready, out = [], []
    for slot in range(len(jobs)):
        while jobs and jobs[0][0] <= slot:
            heapq.heappush(ready, jobs.pop(0)[1:])
        due, s, i = heapq.heappop(ready)
        assert slot < due
        out.append((s, i))
    return out


def scheduled(fluid, step):
    return [x for start, _, lo, hi in mixing.frames(fluid, step) for x in zip(*map(np.ndarray.tolist, mixing.order(fluid, start, lo, hi)))]


@pytest.mark.parametrize("exact", [True, False])
def test_frames_against_a_slot_by_slot_schedule(monkeypatch, exact):
    rng = np.random.default_rng(1)
    for _ in range(80):
        n = int(rng.integers(1, 9))
        blocks = rng.integers(1, 30, n)
        units = rng.integers(1, 9, n) if exact else mixing.units_of(rng.choice([1, 2, 3, 5, 0.1, 0.37, 7.7, 1e-3], n).tolist())
        fluid, step = mixing.Fluid(units, blocks), int(rng.integers(1, 20))
        monkeypatch.setattr(mixing, "SLOTS_A_SOURCE", 0)
        got = scheduled(fluid, step)
        assert got == slow(units, blocks) == scheduled(fluid, 1 << 16)


@pytest.mark.parametrize("n", [150, 5000])
def test_every_source_stays_within_one_block_of_its_share(n):
    rng = np.random.default_rng(n)
    weights = [1e-5 if i % 7 else 1.0 + i % 3 for i in range(n)]
    blocks = rng.integers(1, 60, n)
    blocks[0] = blocks.sum() // 2  # a hot source
    fluid = mixing.Fluid(mixing.units_of(weights), blocks)
    assert (np.abs(fluid.units / fluid.units.sum() - np.array(weights) / sum(weights)) < 1e-15).all()
    took, t = np.zeros(n, int), 0
    ends = np.sort(blocks / np.array(weights))
    by_end = np.argsort(blocks / np.array(weights))
    w = np.array(weights)
    clock = np.concatenate([[0], np.cumsum(np.diff(ends, prepend=0) * np.cumsum(w[by_end][::-1])[::-1])])  # slots passed at each end
    for s, b in scheduled(fluid, 1000):
        assert took[s] == b
        took[s] += 1
        t += 1
        if t % 97 == 0 or t == blocks.sum():
            k = min(int(np.searchsorted(clock, t, side="right")) - 1, n - 1)
            left = w[by_end[k:]].sum()
            v = (ends[k - 1] if k else 0) + (t - clock[k]) / left
            assert np.abs(np.minimum(w * v, blocks) - took).max() < 1 + 1e-6
    assert (took == blocks).all()


def check(rows, n, block_docs, weights=None):
    assert len(rows) == n
    assert sorted(r.slot for r in rows if r.place == 0) == list(range(len({r.slot for r in rows})))
    assert len({r.position for r in rows}) == n and all(r.position == r.slot * block_docs + r.place for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.slot, set()).add(r.phase)
    assert all(len(x) == 1 for x in by.values())


def test_documents(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs, block_docs=8).collect()
    check(rows, docs.count(), 8)
    w = {"src0": 3.0, "src1": 1.0}
    rows = mixing.mix(docs.where("source in ('src0', 'src1')"), w, block_docs=2).collect()
    check(rows, 100, 2)
    first = [r.source for r in sorted(rows, key=lambda r: r.position) if r.phase == 0]
    for t in range(0, len(first), 2):
        assert abs(sum(s == "src0" for s in first[: t + 2]) / 2 - 0.75 * (t / 2 + 1)) < 1


def test_odd_rows(spark):
    rows = [(i % 7 if i % 5 else None, "same", None if i % 3 else "a", "x") for i in range(200)] + [(1, None, "b", "x"), (1, None, "b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, slot string")
    check(mixing.mix(df, block_docs=4).collect(), 202, 4)
    check(mixing.mix(df, {"a": 0.2, "nowhere": 0.5}, block_docs=4).collect(), 202, 4)
    out = mixing.mixed(df, block_docs=4)
    assert out.columns == df.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    assert mixing.mix(df.limit(0)).columns == mixing.mix(df).columns and mixing.mix(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, {"a": -1.0, "b": 1.0}).count()


@pytest.mark.parametrize("bytes_, rows", [(8 << 20, 50_000), (0, 40)])
def test_many_sources_and_one_hot(spark, monkeypatch, bytes_, rows):
    """Whether tables are broadcast or shuffled and sources are ranked in one piece or in several: the same mix."""
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", bytes_)
    monkeypatch.setattr(mixing, "PIECE_ROWS", rows)
    df = spark.range(3000).selectExpr("id as doc_id", "cast(id as string) as text", "if(id % 3 = 0, 'hot', cast(id % 700 as string)) as source")
    got = mixing.mix(df, block_docs=2).collect()
    check(got, 3000, 2)
    sizes = {}
    for r in df.groupBy("source").count().collect():
        sizes[r.source] = r["count"]
    names = sorted(sizes)
    blocks = [-(-sizes[s] // 2) for s in names]
    want = slow(mixing.units_of([sizes[s] ** 0.5 for s in names]), blocks)
    assert {r.slot: (names.index(r.source), r.block) for r in got} == dict(enumerate(want))


def test_files_in_turn_are_the_mix(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixing.mixed(docs, block_docs=4).write.parquet(f"{tmp_path}/mixed")
    got = [i for f in sorted(tmp_path.glob("mixed/part-*")) for i in pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()]
    assert got == [r.doc_id for r in sorted(mixing.mix(docs, block_docs=4).collect(), key=lambda r: r.position)]


def test_sources_that_are_numbers(spark):
    df = spark.range(100).selectExpr("id as doc_id", "'t' as text", "id % 3 as source")
    got = mixing.mix(df, {"0": 1.0, "1": 2.0}, block_docs=2)
    check(got.collect(), 100, 2)
    assert got.schema["source"].dataType == df.schema["source"].dataType
