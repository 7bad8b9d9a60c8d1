"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of its byte trigrams, of unit length; each language has a few centroids, found by spherical
k-means; the language of the centroid at the largest cosine is predicted. A text that lies farther from every centroid
than training texts of as many distinct trigrams do is marked as rejected; pieces of training texts stand for short texts,
and training texts put together for long ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from corvane.llm.batches import slices
from corvane.llm.joins import sized
from corvane.session import give_back, workers_can_import

BITS = 12
DIM = 1 << BITS
UNKNOWN = "und"
_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)
_CHUNK = 1 << 20
_BUCKETS = 40
#: Words of the pieces of training texts from which the distances of short texts are learned.
_PIECE_WORDS = (1, 2, 4, 8, 16, 32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def trigram_counts(text: str) -> np.ndarray:
    """Hashed counts of the trigrams of lower-cased letters, runs of anything else being one space; over the whole text."""
    b = _KEEP[np.frombuffer(text.lower().encode(), np.uint8)]
    b = np.concatenate([[32], b, [32]]).astype(np.uint32)
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])]
    out = np.zeros(DIM, np.int64)
    for at in range(0, len(b) - 2, _CHUNK):
        c = b[at : at + _CHUNK + 2]
        key = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
        out += np.bincount((key * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=DIM)
    return out


def pieces(text: str, h: int) -> list[str]:
    """Parts of the text, of few words, from a place given by h; those without a letter are left out."""
    words = text.split()
    at = [words[k : k + n] for n in _PIECE_WORDS if n < len(words) for k in [h % (len(words) - n + 1)]]
    return [t for t in map(" ".join, at) if has_letter(t)]


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _bucket(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(n + 1).astype(int), _BUCKETS - 1)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    language_of: np.ndarray
    least: np.ndarray  # by bucket of the number of distinct trigrams: a lower cosine is rejected

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.idf).astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether rejected."""
        lang, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        at = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for k in range(0, len(at), 256):
            own = at[k : k + 256]
            counts = np.stack([trigram_counts(texts[i]) for i in own])
            cosine = self.vectors(counts) @ self.centroids.T
            best = cosine.argmax(1)
            top = np.clip(cosine[np.arange(len(own)), best].astype(float), 0, 1)
            score[own], rejected[own] = top, top < self.least[_bucket((counts > 0).sum(1))]
            for i, c in zip(own, best):
                lang[i] = self.languages[self.language_of[c]]
        return lang, score, rejected


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the vectors farthest from those chosen before; no chance in it."""
    c = [_unit(x.mean(0))]
    near = x @ c[0]
    c[0] = x[near.argmax()]
    near = x @ c[0]
    while len(c) < min(k, len(x)):
        c.append(x[near.argmin()])
        near = np.maximum(near, x @ c[-1])
    c = np.stack(c)
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        c = np.stack([_unit(x[at == j].mean(0)) if (at == j).any() else c[j] for j in range(len(c))])
    return c


def _nearest(m: Model, counts: np.ndarray | Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and largest cosine of each row; the rows may come in portions."""
    own = [counts[k : k + 1024] for k in range(0, len(counts), 1024)] if isinstance(counts, np.ndarray) else counts
    found = [(_bucket((c > 0).sum(1)), (m.vectors(c) @ m.centroids.T).max(1)) for c in own if len(c)]
    return tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, int), np.zeros(0, np.float32))


def train(labels: list[str], counts: np.ndarray, clusters: int = 3, slack: float = 0.4, short: np.ndarray | Iterable[np.ndarray] | None = None) -> Model:
    """clusters: centroids a language. slack: a text is rejected below this share of the lowest cosine of training texts as varied.

    short: counts of pieces of training texts. Where fewer than 5 training texts are as varied, pieces and sums of 2, 4, 8, ...
    texts of a language tell the lowest cosine but for 1 %; where there are none of these either, the nearest number of trigrams does.
    """
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.ones(DIM), np.zeros((0, DIM), np.float32), np.zeros(0, int), np.zeros(_BUCKETS))
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1
    number_of = {v: i for i, v in enumerate(languages)}
    m = Model(languages, idf, np.zeros((0, DIM), np.float32), np.zeros(0, int), np.zeros(_BUCKETS))
    x, y = np.concatenate([m.vectors(counts[k : k + 1024]) for k in range(0, len(counts), 1024)]), np.array([number_of[v] for v in labels])
    own = [_kmeans(x[y == i], clusters) for i in range(len(languages))]
    m.centroids, m.language_of = np.concatenate(own).astype(np.float32), np.repeat(np.arange(len(languages)), list(map(len, own)))
    sums = [counts[y == i][:n].sum(0) for i in range(len(languages)) for n in 2 ** np.arange(1, 1 + int(np.log2((y == i).sum())))]
    known = [_nearest(m, counts)]
    known.append(tuple(map(np.concatenate, zip(known[0], *([_nearest(m, np.stack(sums))] if sums else []), *([_nearest(m, short)] if short is not None else [])))))
    filled = []
    for b in range(_BUCKETS):
        for (at, best), enough, low in zip(known, (5, 1), (0, 0.01)):  # pieces may be names or junk, so a few are left out
            if (at == b).sum() >= enough:
                m.least[b] = slack * np.quantile(best[at == b], low, method="lower")
                filled.append(b)
                break
    for b in set(range(_BUCKETS)) - set(filled):
        m.least[b] = m.least[min(filled, key=lambda x: (abs(x - b), x))]
    return m


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_language: int = 400, sample_total: int = 8000, clusters: int = 3, slack: float = 0.4) -> Model:
    """A model of the rows with a language that aren't held out.

    sample_per_language bounds the fit: about so many rows of each language (at most one and a half times), chosen by a hash
    of their id, are turned into counts on the executors and fitted on the driver; with many languages fewer of each, so that about
    sample_total rows are fitted in all, or one a language. Null or letterless texts teach nothing.
    """
    workers_can_import(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit("fit")).alias("h"))
    n = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    most = max(1, min(sample_per_language, sample_total // max(1, len(n))))
    shares = docs.sparkSession.createDataFrame(pa.table({"lang": pa.array(list(n), pa.string()), "share": pa.array([min(1.0, most / c) for c in n.values()], pa.float64())}))
    chosen = known.join(sized(shares, 96), "lang").where(F.pmod("h", F.lit(1 << 32)) / float(1 << 32) < F.col("share")).drop("share")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
        for b in batches:
            rows, own = [], zip(b.column("lang").to_pylist(), b.column("h").to_pylist())
            for texts in slices(b.column("text")):
                for text, (lang, h) in zip(texts, own):
                    if has_letter(text):
                        for part, t in enumerate([text, *pieces(text, h)]):
                            c = trigram_counts(t)
                            at = np.flatnonzero(c)
                            rows.append((lang, h, part > 0, at.astype("<u2").tobytes(), c[at].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], names=["lang", "h", "short", "at", "n"])

    got = sorted((r.short, r.lang, r.h, bytes(r.at), bytes(r.n)) for r in chosen.mapInArrow(count, "lang string, h long, short boolean, at binary, n binary").collect())
    seen: dict[str, int] = {}
    labels, counts, parts = [], [], []

    def dense(at: bytes, c: bytes) -> np.ndarray:
        row = np.zeros(DIM, np.float32)
        row[np.frombuffer(at, "<u2")] = np.frombuffer(c, "<u4")
        return row

    for short, lang, _, at, c in got:
        if short:
            parts.append((at, c))
            continue
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= 1.5 * most:
            labels.append(lang)
            counts.append(dense(at, c))
    short = (np.stack([dense(*x) for x in parts[k : k + 1024]]) for k in range(0, len(parts), 1024))
    return train(labels, np.stack(counts) if counts else np.zeros((0, DIM), np.float32), clusters, slack, short)


PREDICTION = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A struct (lang_pred, score, rejected) of the whole text alone. The model is broadcast: languages x clusters x 16 KB."""
    workers_can_import(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(PREDICTION)
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for s in texts:
            lang, score, rejected = [], [np.zeros(0)], [np.zeros(0, bool)]
            for own in slices(s):
                a, b, c = m.predict(own)
                lang += a
                score.append(b)
                rejected.append(c)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.concatenate(score)), pa.array(np.concatenate(rejected))], names=PREDICTION.names)
        give_back()

    return of(F.col(text_col))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fitting: float) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, lang_pred, score (cosine) and rejected.

    lang_pred is a language of the training rows, `und` (score 0, rejected) for null and letterless texts and where there is nothing
    to learn from. Null ids are never held out; repeated rows are rows of their own; other columns are ignored.
    """
    model = fit(docs, id_col, text_col, lang_col, **fitting)
    return docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), predict(docs, model, text_col).alias("x")).select("doc_id", "held_out", "x.*")


def keep_identified(docs: DataFrame, text_col: str = "text", **fitting: float) -> DataFrame:
    """The rows of `docs`, unchanged, whose language is identified: not `und` and not rejected."""
    x = "__language_id"
    return docs.withColumn(x, predict(docs, fit(docs, text_col=text_col, **fitting), text_col)).where(f"not {x}.rejected").drop(x)
