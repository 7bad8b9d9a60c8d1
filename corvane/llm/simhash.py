"""SimHash near-duplicates found by deletion-variant signatures.

A fingerprint of 64 bits is cut into three segments (22, 21 and 21 bits). Of two fingerprints that differ in at most four
bits, one segment differs in at most one: were it two in each, they would differ in six. So every fingerprint is indexed
under 64 variants, its segments with one bit left out, and fingerprints that share a variant are compared whole. Of
the variants that a pair shares only the first counts, so no pair is counted twice and no `distinct` over pairs is needed.

Distinct fingerprints are compared, not documents: a group of copies is one fingerprint with a count, however large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from corvane.llm.batches import slices
from corvane.llm.components import FOLDED, connected_components, fold_links
from corvane.llm.joins import sized
from corvane.session import cut, give_back, workers_can_import

SHINGLE_WORDS, SEED, MOST_BITS = 4, 42, 4
SEGMENTS = ((0, 22), (22, 43), (43, 64))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE = np.arange(8, dtype=np.int64) * 256
#: Fingerprints that share a variant and still meet in one place; more are cut into blocks, and every two blocks meet.
HOT = 4096
#: Bytes that an id and a text hash take in a broadcast's hash table, besides the id's own.
KEY_BYTES = 112
#: Shingles of which the hashes are held at once.
_CHUNK = 1 << 20


def fingerprint(text: str | None) -> int:
    """64-bit SimHash (unsigned) of the 4-word shingles, repeats included; 0 for null and for texts without words."""
    words = (text or "").encode().lower().split()  # of bytes: lowers A-Z and splits at space and \x09-\x0D only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - SHINGLE_WORDS + 1
    if n <= 1:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    last = ends[SHINGLE_WORDS - 1 :].tolist()
    counts = np.zeros((8, 8), np.int64)
    for at in range(0, n, _CHUNK):
        h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(first[at : at + _CHUNK], last[at : at + _CHUNK])), np.uint64, min(_CHUNK, n - at))
        counts += np.bincount((h.astype("<u8").view(np.uint8).reshape(-1, 8) + _BYTE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits((2 * counts > n).ravel(), bitorder="little").tobytes(), "little")


@F.arrow_udf(LongType())
def simhash64(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for s in texts:
        yield pa.array(np.fromiter((fingerprint(t) for own in slices(s) for t in own), np.uint64, len(s)).view(np.int64))
    give_back()


def _mask(bits: range) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def variants(fp: Column) -> Column:
    """The 64 keys of a fingerprint: the bit left out in the upper bits, the rest of its segment in the lower 22."""
    keys = []
    for lo, hi in SEGMENTS:
        segment = F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).cast("int")
        keys += [segment.bitwiseAND(F.lit(~(1 << (p - lo)))).bitwiseOR(F.lit(p << 22)) for p in range(lo, hi)]
    return F.array(*keys)


def first_shared(key: Column, x: Column) -> Column:
    """Whether `key` is the first variant shared by two fingerprints that have it in common; x: their exclusive or."""
    p = F.shiftrightunsigned(key, 22)
    cases, apart = None, F.lit(True)
    for lo, hi in SEGMENTS:
        differ = F.bit_count(x.bitwiseAND(F.lit(_mask(range(lo, hi)))))
        here = apart & ((differ == 1) | (p == lo))
        cases = F.when(p < hi, here) if cases is None else cases.when(p < hi, here)
        apart = apart & (differ >= 2)
    return cases


def hot_variants(fingerprints: DataFrame) -> DataFrame:
    """(key, blocks) of the variants that more than HOT fingerprints may share, and into how many blocks these are cut.

    A variant holds at most two values of its segment. So it is enough to count the three segment values of each fingerprint: those
    of HOT / 2 or fewer can't make a variant of more than HOT.
    """
    fp = F.col("fp")
    values = [F.struct(F.lit(i).alias("s"), F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).cast("int").alias("v")) for i, (lo, hi) in enumerate(SEGMENTS)]
    counts = fingerprints.select(F.explode(F.array(*values)).alias("x")).groupBy("x.s", "x.v").agg(F.count("*").alias("c")).where(F.col("c") > HOT // 2)
    keys = None
    for i, (lo, hi) in enumerate(SEGMENTS):
        own = F.array(*[F.col("v").bitwiseAND(F.lit(~(1 << (p - lo)))).bitwiseOR(F.lit(p << 22)) for p in range(lo, hi)])
        keys = F.when(F.col("s") == i, own) if keys is None else keys.when(F.col("s") == i, own)
    return counts.select(F.explode(keys).alias("key"), "c").groupBy("key").agg(F.ceil((F.sum("c") + HOT // 2) / HOT).cast("int").alias("blocks"))


def _meet(left: DataFrame, right: DataFrame, on: tuple[str, ...], once: Column) -> DataFrame:
    """Linked pairs (a, b, n_a, n_b) of rows that are equal in `on`, under the first variant that they share.

    Merged by a hint: Spark takes exploded rows to be as few as those before, and would broadcast 64 variants of each fingerprint.
    """
    a, b = left.select(*on, F.col("fp").alias("a"), F.col("n").alias("n_a")), right.select(*on, F.col("fp").alias("b"), F.col("n").alias("n_b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    return a.join(b.hint("merge"), list(on)).where(once & (F.bit_count(x) <= MOST_BITS) & first_shared(F.col("key"), x)).select("a", "b", "n_a", "n_b")


def link(fingerprints: DataFrame) -> DataFrame:
    """fingerprints (fp, n, first), distinct by fp, to (fp, links, component): rows linked through other fingerprints, smallest fp reachable.

    Only fingerprints that have a link to another are returned.
    """
    v = fingerprints.select(F.explode(variants(F.col("fp"))).alias("key"), "fp", "n")
    hot = cut(hot_variants(fingerprints))
    if hot.isEmpty():
        pairs = _meet(v, v, ("key",), F.col("a") < F.col("b"))
    else:
        known = sized(hot, 64)
        cold = v.join(sized(hot.select("key"), 64), "key", "left_anti")
        # block x meets block y once, for every x <= y, in a cell of its own
        w = v.join(known, "key").withColumn("own", F.pmod(F.xxhash64("fp", "key"), F.col("blocks")).cast("int"))
        left = w.withColumn("x", F.col("own")).withColumn("y", F.explode(F.sequence("own", F.col("blocks") - 1)))
        right = w.withColumn("y", F.col("own")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("own"))))
        pairs = _meet(cold, cold, ("key",), F.col("a") < F.col("b")).unionByName(_meet(left, right, ("key", "x", "y"), (F.col("x") < F.col("y")) | (F.col("a") < F.col("b"))))
    # within the join's own tasks the links become counts and forests, so what is shuffled grows with nodes, not pairs
    folded = cut(pairs.mapInArrow(fold_links, FOLDED))
    links = folded.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(folded.where("links is null").select(F.col("node").alias("src"), F.col("root").alias("dst")))
    return links.join(components, "node").select(F.col("node").alias("fp"), "links", "component")


def _grouped(own: DataFrame) -> DataFrame:
    """(fp, n_near, component, component_id) of rows (doc_id, fp)."""
    distinct = own.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    linked = link(distinct)
    classes = distinct.join(linked, "fp", "left").select("fp", "n", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "fp").alias("component"))
    smallest = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    return classes.join(smallest, "component").select("fp", (F.col("n") - 1 + F.col("links")).alias("n_near"), "component", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), n_near and component_id.

    n_near counts the other rows at four or fewer differing bits, component_id is the smallest id reachable over such
    links. Null and wordless texts have fingerprint zero and are linked like any other; rows with equal ids are
    rows of their own; a null id is passed over as smallest id (a component of null ids alone has component_id null);
    an empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    workers_can_import(docs.sparkSession)
    own = cut(docs.select(F.col(id_col).alias("doc_id"), simhash64(F.col(text_col)).alias("fp")))
    return own.join(_grouped(own), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "n_near", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays, unchanged: that of the smallest id (null last), among equal ids that of the smallest text hash.

    Of rows equal in id and text any one stays. An empty table gives an empty result.
    """
    workers_can_import(docs.sparkSession)
    own = cut(docs.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"), simhash64(F.col(text_col)).alias("fp")))
    of = own.join(_grouped(own.withColumnRenamed("i", "doc_id")).select("fp", "component"), "fp")
    key = F.struct(F.col("i").isNull().alias("none"), "i", "h")
    best = of.groupBy("component").agg(F.min(key).alias("best"), F.count("*").alias("n")).where("n > 1")
    held = cut(of.select("component", key.alias("k")).groupBy("component", "k").agg(F.count("*").alias("times")).join(best.select("component", "best"), "component").select(F.col("k.i").alias("__i"), F.col("k.h").alias("__h"), (F.col("k") == F.col("best")).alias("stays"), "times"))

    def among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select("__i", "__h")
        # in a hash table a row takes KEY_BYTES and, in its key and again in its value, the id's bytes
        keys = sized(keys, F.lit(KEY_BYTES) + 2 * F.coalesce(F.octet_length(F.col("__i").cast("string")), F.lit(0)))
        return rows.join(keys, rows[id_col].eqNullSafe(keys["__i"]) & (F.xxhash64(rows[text_col]) == keys["__h"]), how)

    out = among(docs, held.where("not stays"), "left_anti")
    twice = held.where("stays and times > 1")
    if twice.isEmpty():
        return out
    return among(out, twice, "left_anti").unionByName(among(out, twice, "left_semi").dropDuplicates([id_col, text_col]))
