"""Byte-level BPE by prefix dynamic programming.

Of every prefix of a byte string, the encoding ends with one token; that token is all that is stored. A token may follow
the encoding of the prefix before it if and only if the two tokens beside each other survive their own merges, which is
decided on the pair alone. So an append goes on from the stored tokens, and after an edit the tokens are computed
afresh only until they agree with the old ones again over the length of the longest token.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from corvane.llm.batches import slices
from corvane.session import give_back, workers_can_import

#: Distinct pre-tokens, and token pairs, that a worker remembers in a young and an old generation each: a full young one becomes the
#: old one, from which what is met again comes back. So the frequent ones stay. Results don't depend on it.
REMEMBERED = 200_000
#: Characters of a pre-token that is remembered at most, which bounds the bytes.
_REMEMBERED_CHARS = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token of a file with a token in base64 and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PrefixBPE:
    def __init__(self, ranks: dict[bytes, int], remembered: int = REMEMBERED):
        self.ranks, self.remembered = ranks, remembered
        self.tokens = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.text = {r: str(r) for r in self.tokens}
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[int, bool] = {}
        self._older: dict[int, bool] = {}
        self._ends: ahocorasick.Automaton | None = None
        self._lengths = {r: len(t) for t, r in ranks.items()}

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None of a byte, and of a token that merges never make."""
        if token not in self._parts:
            own, ranks = self.tokens[token], self.ranks
            bits = [own[i : i + 1] for i in range(len(own))]
            while len(bits) > 2:
                r, i = min(((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(bits, bits[1:]))), default=(1 << 40, 0))
                if r == 1 << 40:
                    break
                bits[i : i + 2] = [bits[i] + bits[i + 1]]
            self._parts[token] = (ranks[bits[0]], ranks[bits[1]]) if len(bits) == 2 else None
        return self._parts[token]

    def made(self, token: int) -> bool:
        """Whether the merges of its own bytes give this token."""
        return len(self.tokens[token]) == 1 or self.parts(token) is not None

    def beside(self, a: int, b: int) -> bool:
        """Whether a then b is the encoding of their joint bytes, b being one that merges make: undo merges, the latest first, and see that none across the border came before."""
        key = (a << 32) | b
        known = self._pairs.get(key)
        if known is not None:
            return known
        if len(self._pairs) >= self.remembered:
            self._older = dict(self._pairs)
            self._pairs.clear()
        known = self._older.get(key)
        if known is not None:
            self._pairs[key] = known
            return known
        x, y, limit, fine = a, b, 1 << 40, self.made(b)
        while fine:
            if self.ranks.get(self.tokens[x] + self.tokens[y], limit) < limit:
                fine = False
                break
            left, right = self.parts(x), self.parts(y)
            if left is None and right is None:
                break
            if right is None or (left is not None and x > y):
                x, limit = left[1], x  # of equal ranks the left pair merges first, so only a lower rank forbids
            else:
                y, limit = right[0], y + 1
        self._pairs[key] = fine
        return fine

    def extend(self, data: bytes, last: list[int], upto: int | None = None) -> list[int]:
        """Last tokens of the prefixes of `data` beyond those in `last`, which it lengthens."""
        get, beside, longest = self.ranks.get, self.beside, self.longest
        for i in range(len(last) + 1, (len(data) if upto is None else upto) + 1):
            for start in range(max(0, i - longest), i):
                t = get(data[start:i])
                if t is not None and (beside(last[start - 1], t) if start else self.made(t)):
                    last.append(t)
                    break
            else:
                raise ValueError(f"no token for byte {data[i - 1]}")
        return last

    def ids(self, data: bytes, last: list[int]) -> list[int]:
        out, i = [], len(data)
        while i:
            out.append(last[i - 1])
            i -= self._lengths[out[-1]]
        return out[::-1]

    def prefixes(self, data: bytes) -> list[int]:
        """What `extend` gives from nothing, with the tokens that end at each byte found by an automaton in one pass."""
        if self._ends is None:
            self._ends = ahocorasick.Automaton()
            for token, r in self.ranks.items():
                self._ends.add_word(token.decode("latin-1"), r)
            self._ends.make_automaton()
        last, known, lengths, i = [], self._pairs.get, self._lengths, 0
        for end, t in self._ends.iter(data.decode("latin-1")):
            if end < i:
                continue
            at = end - lengths[t]
            if at >= 0:
                fine = known((last[at] << 32) | t)
                if fine is None:
                    fine = self.beside(last[at], t)
            else:
                fine = self.made(t)
            if fine:
                last.append(t)
                i += 1
        if i < len(data):
            raise ValueError(f"no token for byte {data[i]}")
        return last

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.ids(piece, self.prefixes(piece))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Edited:
    """A byte string kept encoded while it is appended to and edited."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data = bpe, data
        self.last = bpe.extend(data, [])

    def append(self, more: bytes) -> None:
        self.data += more
        self.bpe.extend(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put `new` in place of data[start:end]; the number of prefixes that were computed afresh."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        last, same, i = old[:start], 0, start
        while i < len(self.data):
            self.bpe.extend(self.data, last, i + 1)
            i += 1
            same = same + 1 if i > start + len(new) and old[i - 1 - shift] == last[-1] else 0
            if same >= self.bpe.longest:
                last += old[i - shift :]
                break
        self.last = last
        return i - start

    @property
    def ids(self) -> list[int]:
        return self.bpe.ids(self.data, self.last)


class TextEncoder(dict):
    """Pre-token to ids, filled as pre-tokens come."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        self.bpe, self.split, self.remembered = PrefixBPE(read_ranks(path), remembered), regex.compile(pattern).findall, remembered
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            ids = tuple(self.bpe.encode(piece.encode()))
            if len(piece) > _REMEMBERED_CHARS:
                return ids
        if len(self) >= self.remembered:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        pieces = self.split(text or "")
        return list(chain.from_iterable(map(self.__getitem__, pieces)))

    def forget(self) -> None:
        self.clear()
        self.older.clear()
        self.bpe.__dict__.clear()


_KEPT: dict[tuple, TextEncoder] = {}


@contextmanager
def encoder(*which, keep: bool = False) -> Iterator[TextEncoder]:
    """An encoder for a task. What it remembers goes at the task's end, or is kept for the worker process's next one."""
    e = _KEPT.get(which) or TextEncoder(*which)
    try:
        yield e
    finally:
        if keep:
            _KEPT[which] = e
        else:
            _KEPT.pop(which, None)
            e.forget()
            del e
        give_back()


def ids_of(e: TextEncoder, texts: pa.Array) -> pa.ListArray:
    parts, counts = [], []
    for own in slices(texts):
        ids = [e.encode(t) for t in own]
        counts += map(len, ids)
        parts.append(np.fromiter(chain.from_iterable(ids), np.int32, sum(map(len, ids))))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """`docs` with a column of token ids. Null and empty texts have no ids; all columns of `docs` stay but one named `ids_col`."""
    workers_can_import(docs.sparkSession)

    @F.arrow_udf(ArrayType(IntegerType()))
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with encoder(path, pattern, keep=True) as e:
            for s in texts:
                yield ids_of(e, s)

    return docs.withColumn(ids_col, of(F.col(text_col)))


CHECKED = StructType([StructField("ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType())])


def encode_checked(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", check_col: str = "round_trip", remembered: int = REMEMBERED) -> DataFrame:
    """`encode`, and whether the ids decode to the text's bytes, in one pass. remembered: as REMEMBERED, less where workers share little memory."""
    workers_can_import(docs.sparkSession)

    @F.arrow_udf(CHECKED)
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with encoder(path, pattern, remembered) as e:
            for s in texts:
                ids = ids_of(e, s)
                flat, ends, fine, k = ids.values.to_numpy(), ids.offsets.to_numpy(), [], 0
                for own in slices(s):
                    for t in own:
                        fine.append(e.bpe.decode(flat[ends[k] : ends[k + 1]].tolist()) == (t or "").encode())
                        k += 1
                yield pa.StructArray.from_arrays([ids, pa.array(fine, pa.bool_())], names=CHECKED.names)

    x = "__encoded"
    return docs.withColumn(x, of(F.col(text_col))).withColumns({ids_col: F.col(x)["ids"], check_col: F.col(x)["round_trip"]}).drop(x)


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """`encoded` with the text of its ids; bytes that aren't UTF-8 are replaced, null ids give null."""
    workers_can_import(encoded.sparkSession)

    @F.arrow_udf(StringType())
    def of(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with encoder(path, pattern) as e:
            for s in ids:
                yield pa.array([None if x is None else e.bpe.decode(x).decode("utf-8", "replace") for own in slices(s) for x in own], pa.string())

    return encoded.withColumn(text_col, of(F.col(ids_col)))


DIGEST = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_tokens, ids_sha256 and decoded_sha256 of its text's ids and of the bytes decoded from them.

    A row needs nothing of any other, so there is no shuffle. Null and empty texts have no tokens and the digest of the empty
    string; null and repeated ids are rows of their own; other columns are ignored.
    """
    workers_can_import(docs.sparkSession)

    @F.arrow_udf(DIGEST)
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sha = hashlib.sha256
        with encoder(path, pattern, keep=True) as e:
            for s in texts:
                n, ids_sha, decoded_sha = [], [], []
                for own in slices(s):
                    for t in own:
                        ids = e.encode(t)
                        n.append(len(ids))
                        ids_sha.append(sha(" ".join(map(e.bpe.text.__getitem__, ids)).encode()).hexdigest())
                        decoded_sha.append(sha(e.bpe.decode(ids)).hexdigest())
                yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=DIGEST.names)

    return docs.select(F.col(id_col).alias("doc_id"), of(F.col(text_col)).alias("x")).select("doc_id", "x.*")
