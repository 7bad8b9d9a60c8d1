"""Embedders: a function of texts to vectors, supplied by the user; a hashing embedder where none is."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import query_terms
from corvane.schemas import VECTOR
from corvane.session import give_back

Embedder = Callable[[list[str]], list[list[float]]]
#: Texts given to an embedder at once.
BATCH = 64
DIM = 384
HASHING_MODEL = "hashing-384"
#: Words of a text that are hashed at once; letters of a word that is remembered.
WORDS, LONGEST = 4096, 64


def _hashed(term: str) -> tuple[np.ndarray, np.ndarray]:
    """Components and signed weights of a term: its own and those of its trigrams."""
    grams = [term, *(f"^{term}$"[k : k + 3] for k in range(len(term)))]
    h = np.array([zlib.crc32(g.encode()) for g in grams], np.int64)
    return h % DIM, np.where(h >> 31, 1.0, -1.0) * np.array([2.0] + [0.5] * (len(grams) - 1))


_remembered = lru_cache(100_000)(_hashed)


def hashing_embedder(texts: list[str]) -> list[list[float]]:
    """Signed feature hashing of words and their character trigrams, of unit length; the same on every worker and in every run."""
    out = np.zeros((len(texts), DIM))
    for i, text in enumerate(texts):
        words = query_terms(text)
        for k in range(0, len(words), WORDS):
            found = [(_remembered if len(t) <= LONGEST else _hashed)(t) for t in words[k : k + WORDS]]
            np.add.at(out[i], np.concatenate([at for at, _ in found]), np.concatenate([w for _, w in found]))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).tolist()


def onnx_embedder(model: str, tokenizer: str, longest: int = 256) -> Embedder:
    """Mean-pooled, normalised sentence vectors of an ONNX model and a tokenizer file, loaded once a worker; both are the user's."""
    loaded: list = []

    def embed(texts: list[str]) -> list[list[float]]:
        if not loaded:
            import onnxruntime
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(tokenizer)
            t.enable_truncation(longest)
            t.enable_padding()
            loaded[:] = [onnxruntime.InferenceSession(model), t]
        session, t = loaded
        enc = t.encode_batch(texts)
        feed = {"input_ids": np.array([e.ids for e in enc]), "attention_mask": np.array([e.attention_mask for e in enc]), "token_type_ids": np.array([e.type_ids for e in enc])}
        states = session.run(None, {i.name: feed[i.name] for i in session.get_inputs()})[0]
        mask = feed["attention_mask"][:, :, None]
        mean = (states * mask).sum(1) / np.maximum(mask.sum(1), 1)
        return (mean / np.linalg.norm(mean, axis=1, keepdims=True)).tolist()

    return embed


def embedding(embedder: Embedder, text: Column) -> Column:
    """Vectors of a text column, in batches, where the rows are."""

    @F.arrow_udf(VECTOR)
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in texts:
            parts = [pa.array([], pa.list_(pa.float32()))]
            for i in range(0, len(s), BATCH):
                # an embedder's lists take eight times the vectors: only one call's are held
                own = [np.asarray(v, np.float32) for v in embedder([t or "" for t in s.slice(i, BATCH).to_pylist()])]
                parts.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), pa.array(np.concatenate(own))))
            yield pa.concat_arrays(parts)
        give_back()

    return of(text)
