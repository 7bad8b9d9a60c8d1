"""Mixing sources to target weights by Pfair scheduling.

The documents of a source, in an order given by a hash, form blocks. In the fluid mix every source that still has blocks is served
all the time, in proportion to its weight, so block i of a source with weight w is served while a virtual clock goes from
i / w to (i + 1) / w; by that clock t(V) = sum over the sources of min(w V, blocks) slots have passed. The block is released at
floor(t(i / w)) and due by ceil(t((i + 1) / w)), and in each slot the released block with the earliest deadline goes next. So at every slot
each source, whatever its weight, is within one block of its share, and when one runs out the others go on in their remaining
proportions. No document is dropped or repeated.

The schedule is computed in frames. What a frame leaves over is found from counts alone: its idle slots, seen from the blocks due within it,
are those in which a block due later runs, of which there is one a source at most. So the driver goes from frame to frame, and the
tasks schedule the blocks within them. Weights are integers of 60 bits and all divisions are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import give_back, workers_can_import

#: Documents of a block.
BLOCK_DOCS = 32
#: Slots of a frame, and slots for each source in it, at least.
FRAME, SLOTS_A_SOURCE = 1 << 16, 64
#: Rows of a source that one task ranks, on average at most.
PIECE_ROWS = 4096
#: Bytes up to which a table that is joined is broadcast; its rows are counted before.
BROADCAST_BYTES = 8 << 20
_BITS = 60


def units_of(weights: list[float]) -> np.ndarray:
    """Weights as integers whose sum is about 2^60, at least one each."""
    exact = [Fraction(w) for w in weights]
    total = sum(exact)
    return np.array([max(1, round(w * (1 << _BITS) / total)) for w in exact], np.int64)


def _floor_div(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """floor(a b / c) of non-negative integers, exactly, for quotients below 2^50 and c up to 2^61: the remainder tells by how much the float is off."""
    a, b, c = (np.asarray(x, np.int64) for x in (a, b, c))
    q = np.floor(a.astype(np.float64) * b.astype(np.float64) / np.maximum(c, 1).astype(np.float64)).astype(np.int64)
    with np.errstate(over="ignore"):
        rest = a * b - c * q  # modulo 2^64, where the true remainder is small
    return q + np.where(c > 0, rest // np.maximum(c, 1), 0)


def _least(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Whether a b >= c d, exactly: where floats can't tell, the difference is small, so that it is right modulo 2^64."""
    x, y = a.astype(float) * b.astype(float), c.astype(float) * d.astype(float)
    with np.errstate(over="ignore"):
        return np.where(np.abs(x - y) <= 1e-12 * np.maximum(x, y), a * b - c * d >= 0, x > y)


class Fluid:
    """The fluid mix of sources with `units` (integer weights) and `blocks`."""

    def __init__(self, units: np.ndarray, blocks: np.ndarray):
        self.units, self.blocks = np.asarray(units, np.int64), np.asarray(blocks, np.int64)
        u, n, order = self.units, self.blocks, np.argsort(self.blocks / self.units, kind="stable")
        while True:  # floats may have put some that are nearly equal in the wrong order
            a, b = order[:-1], order[1:]
            wrong = np.flatnonzero(~_least(n[b], u[a], n[a], u[b]))
            if not len(wrong):
                break
            i = wrong[np.concatenate([[True], np.diff(wrong) > 1])]
            order[i], order[i + 1] = order[i + 1], order[i].copy()
        self.last, self.ends = order, n[order] / u[order]
        # after the first k sources are out: their blocks, and the weight of the others
        self.gone = np.concatenate([[0], np.cumsum(n[order])])
        self.weight = np.concatenate([[0], np.cumsum(u[order][::-1])])[::-1].copy()
        self.times = self.gone[:-1] + self.weight[:-1].astype(float) * self.ends  # the slot, with its fraction, at which each is out
        self.total = int(n.sum())

    def _settled(self, k: np.ndarray, out) -> np.ndarray:
        """Number of sources that are out, from one that floats gave; out: by place in the order of the ends, whether that source is."""
        k, n = np.array(k, np.int64), len(self.ends)
        while True:
            up = (k < n) & out(np.minimum(k, n - 1))
            down = (k > 0) & ~out(np.maximum(k - 1, 0))
            if not (up | down).any():
                return k
            k += up.astype(int) - (down & ~up)

    def _at(self, source: np.ndarray, i: np.ndarray, up: bool) -> np.ndarray:
        c = self.units[source]
        out = lambda k: _least(i, self.units[self.last[k]], self.blocks[self.last[k]], c)
        k = self._settled(np.searchsorted(self.ends, i / c, side="right"), out)
        w = self.weight[k]
        f = _floor_div(w, i, c)
        with np.errstate(over="ignore"):
            return self.gone[k] + f + (up & (w * i - c * f > 0))

    def releases(self, source: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._at(source, i, False)

    def deadlines(self, source: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._at(source, i + 1, True)

    def phase(self, slot: np.ndarray) -> np.ndarray:
        """How many sources are out by the slot."""
        slot = np.asarray(slot, np.int64)
        out = lambda k: _least(np.maximum(slot - self.gone[k], 0), self.units[self.last[k]], self.weight[k], self.blocks[self.last[k]])
        return self._settled(np.searchsorted(self.times, slot, side="right"), out)

    def due(self, slot: int) -> tuple[np.ndarray, np.ndarray]:
        """How many blocks of each source are due by the slot, and how many are released before it."""
        k = int(self.phase(np.array([slot]))[0])
        if k == len(self.units):
            return self.blocks, self.blocks
        passed, w = np.int64(slot - self.gone[k]), self.weight[k]
        done = _floor_div(self.units, passed, w)
        with np.errstate(over="ignore"):
            begun = done + (self.units * passed - w * done > 0)
        return np.minimum(done, self.blocks), np.minimum(begun, self.blocks)


def _jobs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(source, block) of the blocks lo to hi - 1 of each source."""
    n = np.maximum(hi - lo, 0)
    source = np.repeat(np.arange(len(n)), n)
    return source, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def frames(fluid: Fluid, least: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first slot, end, blocks of each source before, blocks after) of each frame: what earliest-deadline-first leaves done at its end."""
    step = max(least or FRAME, SLOTS_A_SOURCE * len(fluid.units))
    lo = np.zeros(len(fluid.units), np.int64)
    for start in range(0, fluid.total, step):
        end = min(start + step, fluid.total)
        due, begun = fluid.due(end)
        due = np.maximum(due, lo)
        source, block = _jobs(lo, due)
        arrived = np.cumsum(np.bincount(np.clip(fluid.releases(source, block) - start, 0, end - start - 1), minlength=end - start))
        idle = np.maximum(np.maximum.accumulate(np.arange(1, end - start + 1) - arrived), 0)
        free = np.flatnonzero(np.diff(idle, prepend=0)) + start
        later = np.flatnonzero(begun > due)
        wait = sorted(zip(fluid.releases(later, due[later]).tolist(), fluid.deadlines(later, due[later]).tolist(), later.tolist()), reverse=True)
        hi, ready = due.copy(), []
        for slot in free.tolist():
            while wait and (wait[-1][0] <= slot or not ready):
                _, d, s = wait.pop()
                heapq.heappush(ready, (d, s))
            if ready:
                hi[heapq.heappop(ready)[1]] += 1
        yield start, end, lo, hi
        lo = hi


def order(fluid: Fluid, start: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(source, block) of each slot from `start` on: the blocks lo to hi - 1 of the sources, earliest deadline first."""
    source, block = _jobs(lo, hi)
    release, due = np.maximum(fluid.releases(source, block), start), fluid.deadlines(source, block)
    at = np.lexsort((source, due, release))
    wait, when, n = list(zip(due[at].tolist(), source[at].tolist(), at.tolist())), release[at].tolist(), len(at)
    ready: list[tuple[int, int, int]] = []
    out, k = np.empty(n, np.int64), 0
    for j in range(n):
        while k < n and (when[k] <= start + j or not ready):
            heapq.heappush(ready, wait[k])
            k += 1
        out[j] = heapq.heappop(ready)[2]
    return source[out], block[out]


def period(units: list[int]) -> list[int]:
    """The schedule of sources that have as many blocks as they weigh: for each slot the index of the source whose block goes next."""
    own = np.array(units, np.int64)
    fluid = Fluid(own, own)
    return [int(s) for start, _, lo, hi in frames(fluid) for s in order(fluid, start, lo, hi)[0]]


_SCHEDULED = "class int, block long, slot long, phase int"


def schedule(spark, fluid: Fluid) -> DataFrame:
    """(class, block, slot, phase) of every block; the frames are scheduled in the tasks. What is sent to them is two numbers a source."""
    rows = []
    for k, (start, end, lo, hi) in enumerate(frames(fluid)):
        own = np.flatnonzero(hi > lo)
        rows.append((k, start, own, lo[own], hi[own]))
    columns = dict(zip(("frame", "start", "own", "lo", "hi"), zip(*rows)))
    table = pa.table({k: pa.array(list(v), pa.list_(pa.int64()) if k in ("own", "lo", "hi") else pa.int64()) for k, v in columns.items()})
    units, blocks = fluid.units, fluid.blocks

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Fluid(units, blocks)
        for b in batches:
            for start, own, *ends in zip(*(b.column(c).to_pylist() for c in ("start", "own", "lo", "hi"))):
                lo, hi = np.zeros((2, len(units)), np.int64)
                lo[own], hi[own] = ends
                source, block = order(f, start, lo, hi)
                slot = start + np.arange(len(source))
                yield pa.RecordBatch.from_arrays([pa.array(source.astype(np.int32)), pa.array(block), pa.array(slot), pa.array(f.phase(slot).astype(np.int32))], names=["class", "block", "slot", "phase"])
        give_back()

    # a table of Arrow data is a local relation: no Python process is started to read it
    return spark.createDataFrame(table).repartition(min(len(rows), spark.sparkContext.defaultParallelism), "frame").mapInArrow(within, _SCHEDULED)


def _joined(rows: DataFrame, other: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Join with a table of `size` bytes: broadcast if these are few, else by a shuffle."""
    return rows.join(F.broadcast(other) if size <= BROADCAST_BYTES else other.hint("merge"), keys)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_docs: int = BLOCK_DOCS, temperature: float = 0.5, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of `docs`: doc_id, source, block, phase, slot, place, position, and the columns in `keep`.

    weights: target by source; each source without one (and null, which is a source of its own) weighs the mean of those given divided by the number
    of sources without one. Without weights a source weighs its number of documents to the power `temperature`. Weights count as multiples of 2^-60
    of their sum. phase is the number of sources that are out by the slot. slot is the block's place in the mix, place the row's in its block
    (0 to block_docs - 1; the last block of a source may be short), and position = slot x block_docs + place orders the mix. Rows of a
    source are taken in the order of a hash of id and text; equal rows are rows of their own in any order. An empty table gives an
    empty result; other columns are ignored. The driver holds some numbers a source, whatever the number of documents.
    """
    spark = docs.sparkSession
    workers_can_import(spark)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit(seed)).alias("h"), *[F.expr(k) for k in keep])
    rest = [c for c in own.columns if c not in ("doc_id", "source", "h")]
    counts = sorted(((r["s"], r["count"]) for r in own.groupBy(F.col("source").cast("string").alias("s")).count().collect()), key=lambda r: (r[0] is None, str(r[0])))
    if not counts:
        kinds = (("block", "long"), ("phase", "int"), ("slot", "long"), ("place", "int"), ("position", "long"))
        return own.select("doc_id", "source", *[F.lit(0).cast(t).alias(n) for n, t in kinds], *rest)
    sizes = np.array([n for _, n in counts], np.int64)
    if weights is not None:
        if any(not w > 0 for w in weights.values()):
            raise ValueError("weights must be positive")
        without = sum(s not in weights for s, _ in counts)
        mean = sum(weights.values()) / len(weights) if weights else 1.0
        target = [weights.get(s, mean / max(1, without)) for s, _ in counts]
    else:
        target = [float(n) ** temperature for n in sizes]
    fluid = Fluid(units_of(target), -(-sizes // block_docs))
    # a source's rows are ranked in pieces of its hashes, so that no task sorts a whole source
    bits = np.array([max(0, ceil(log2(n / PIECE_ROWS))) for n in sizes], np.int32)
    classes = spark.createDataFrame(pa.table({"__source": pa.array([s for s, _ in counts], pa.string()), "class": pa.array(np.arange(len(counts), dtype=np.int32)), "bits": pa.array(bits)}))
    own = own.withColumn("__s", F.col("source").cast("string"))
    width = sum(40 + len(str(s)) for s, _ in counts)
    own = own.join(F.broadcast(classes) if width <= BROADCAST_BYTES else classes.hint("merge"), F.col("__s").eqNullSafe(F.col("__source"))).withColumn("piece", F.expr("shiftrightunsigned(shiftrightunsigned(h, 1), 63 - bits)"))
    before = F.expr("sum(n) over (partition by class order by piece) - n")
    pieces = own.groupBy("class", "piece").agg(F.count("*").alias("n")).select("class", "piece", before.alias("before"))
    ranked = _joined(own, pieces, ["class", "piece"], int((1 << bits.astype(np.int64)).sum()) * 40)
    ranked = ranked.withColumn("rank", F.expr("row_number() over (partition by class, piece order by h, doc_id)") - 1 + F.col("before"))
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block_docs)).withColumn("place", (F.col("rank") % block_docs).cast("int"))
    out = _joined(ranked, schedule(spark, fluid), ["class", "block"], fluid.total * 40)
    return out.select("doc_id", "source", "block", "phase", "slot", "place", (F.col("slot") * block_docs + F.col("place")).alias("position"), *rest)


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, **options) -> DataFrame:
    """The rows of `docs` in the order of the mix: ranges of positions by partition, sorted within, so that files written in turn are the mix."""
    rows = mix(docs, weights, keep=("struct(*) as __row",), **options)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-docs.count() // options.get("block_docs", BLOCK_DOCS)))
    # positions are dense, so ranges of them need no sampling pass; a source's last block may be short, which only adds slots
    own = F.least(F.floor(F.col("slot") * parts / blocks).cast("int"), F.lit(parts - 1))
    return rows.repartitionById(parts, own).sortWithinPartitions("position").select("__row.*")
