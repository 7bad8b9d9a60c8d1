"""Token counts of a unigram tokenizer by dynamic programming over a trie.

The best segmentation of a string under a unigram model is the largest sum of piece scores, and the forward scores of a
prefix don't depend on what follows. So the distinct pre-tokens of a task stand in a trie (of long ones the first bytes): the score of each node is
computed once, however many pre-tokens share it, and the node where a pre-token ends keeps its number of tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from corvane.llm.bpe import read_ranks
from corvane.session import give_back, workers_can_import

#: Nodes of a worker's trie; beyond, it is cut down to the root and grows again. Results don't depend on it.
MOST_NODES = 1_000_000
#: Bytes of a pre-token that stand in the trie. What is behind them is computed for that pre-token alone, and only the scores
#: that a piece can reach back to are held, so a text without a single space takes no more memory than its bytes.
STORED = 64


def scores_by_rank(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """Log-probabilities of the pieces of a vocabulary whose order is all that is known: Zipf's law in the rank."""
    norm = math.log(sum(1 / (r + 2.7) for r in ranks.values()))
    return {t: -math.log(r + 2.7) - norm for t, r in ranks.items()}


class ForwardTrie:
    """Pre-tokens with the forward scores of their prefixes.

    A node is a number; `children` has the node behind a node and a byte, `score` and `tokens` are those of the best segmentation of its
    prefix (the higher score; of equal scores the fewer tokens).
    """

    def __init__(self, scores: dict[bytes, float]):
        self.pieces = ahocorasick.Automaton()  # finds the pieces that end at each byte
        for piece, s in scores.items():
            self.pieces.add_word(piece.decode("latin-1"), (len(piece) - 1, s))
        self.pieces.make_automaton()
        self.longest = max(map(len, scores))
        self.computed = 0
        self._cut()

    def _cut(self) -> None:
        self.children: dict[int, int] = {}
        self.score, self.tokens = [0.0], [0]

    @property
    def nodes(self) -> int:
        return len(self.score) - 1

    def count(self, word: bytes) -> tuple[int, float]:
        """Tokens and score of the best segmentation."""
        if len(self.score) > MOST_NODES:
            self._cut()
        path = self._path(word[:STORED])
        return self._beyond(word, path) if len(word) > STORED else (self.tokens[path[-1]], self.score[path[-1]])

    def _path(self, word: bytes) -> list[int]:
        """The nodes of a word from the root."""
        children, score, tokens = self.children, self.score, self.tokens
        node, path = 0, [0]
        for b in word:
            node = children.get(node << 8 | b, 0)
            if not node:
                break
            path.append(node)
        shared = at = len(path) - 1
        if shared < len(word):
            best, fewest = -math.inf, 0

            def grow() -> None:
                if at != len(path) - 1 or best == -math.inf:
                    raise ValueError(f"no piece ends at byte {word[len(path) - 1]}")
                children[path[at] << 8 | word[at]] = len(score)
                path.append(len(score))
                score.append(best)
                tokens.append(fewest)

            for end, (back, s) in self.pieces.iter(word.decode("latin-1")):
                if end < shared:
                    continue
                if end > at:
                    grow()
                    at, best = end, -math.inf
                before = path[end - back]
                s += score[before]
                if s > best or (s == best and tokens[before] + 1 < fewest):
                    best, fewest = s, tokens[before] + 1
            grow()
            self.computed += len(path) - 1 - shared
            if len(path) <= len(word):
                raise ValueError(f"no piece ends at byte {word[len(path) - 1]}")
        return path

    def _beyond(self, word: bytes, path: list[int]) -> tuple[int, float]:
        """What count() gives, from the nodes of the first bytes on, with a ring of the last scores."""
        size = self.longest + 1
        score, tokens = [-math.inf] * size, [0] * size
        for k in range(max(0, STORED + 1 - size), STORED + 1):
            score[k % size], tokens[k % size] = self.score[path[k]], self.tokens[path[k]]
        skip = max(0, STORED - self.longest)
        done, best, fewest = STORED, -math.inf, 0
        for end, (back, s) in self.pieces.iter(word[skip:].decode("latin-1")):
            end += skip
            if end < STORED or end - back < skip:
                continue
            if end > done:
                if end > done + 1 or best == -math.inf:
                    break
                done += 1
                score[done % size], tokens[done % size], best = best, fewest, -math.inf
            k = (end - back) % size
            s += score[k]
            if s > best or (s == best and tokens[k] + 1 < fewest):
                best, fewest = s, tokens[k] + 1
        if done < len(word) - 1 or best == -math.inf:
            raise ValueError(f"no piece ends at byte {word[done]}")
        return fewest, best


class Counter(dict):
    """Pre-token to its terminal count and score, as one complex number so that a text's are summed in one go."""

    #: A full young generation becomes the old one, from which what is met again comes back; so frequent pre-tokens stay.
    MOST = 200_000

    def __init__(self, path: str, pattern: str):
        self.trie, self.split = ForwardTrie(scores_by_rank(read_ranks(path))), regex.compile(pattern).findall
        self.older: dict[str, complex] = {}

    def __missing__(self, piece: str) -> complex:
        found = self.older.get(piece)
        if found is None:
            found = complex(*self.trie.count(piece.encode()))
        if len(piece) <= STORED:
            if len(self) >= self.MOST:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found

    def of(self, text: str | None) -> tuple[int, int, float]:
        pieces = self.split(text or "")
        total = sum(map(self.__getitem__, pieces), 0j)
        return len(pieces), int(total.real), total.imag


#: A worker process keeps its trie, which is bounded, for its next task.
_COUNTERS: dict[tuple[str, str], Counter] = {}
COUNTS = StructType([StructField("n_pretokens", LongType()), StructField("n_tokens", LongType()), StructField("log_prob", DoubleType())])


def count(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_pretokens, n_tokens and log_prob of the best unigram segmentation of its whole text.

    `path` is a vocabulary of ranks, from which the piece scores follow by Zipf's law. Each worker keeps its own trie, so there is no
    shuffle. Null and empty texts count nothing; null and repeated ids are rows of their own; other columns are ignored.
    """

    workers_can_import(docs.sparkSession)

    @F.pandas_udf(COUNTS)
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if (path, pattern) not in _COUNTERS:
            _COUNTERS[path, pattern] = Counter(path, pattern)
        c = _COUNTERS[path, pattern]
        for s in texts:
            yield pd.DataFrame([c.of(t) for t in s], columns=COUNTS.names, index=s.index)
        give_back()

    return docs.select(F.col(id_col).alias("doc_id"), of(F.col(text_col)).alias("x")).select("doc_id", "x.*")
