import math
import resource

import public_tokenizers
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import token_counts
from corvane.llm.bpe import read_ranks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCORES = token_counts.scores_by_rank(read_ranks(PATH))


def viterbi(word):
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        best.append(max((best[j][0] + SCORES[word[j:i]], best[j][1] - 1) for j in range(i) if word[j:i] in SCORES))
    return -best[-1][1], best[-1][0]


TRIE = token_counts.ForwardTrie(SCORES)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=12), st.text(alphabet="theringaon d", max_size=20)))
def test_words(text):
    assert TRIE.count(text.encode()) == viterbi(text.encode())


def test_prefixes_are_computed_once():
    t = token_counts.ForwardTrie(SCORES)
    for w in (b"there", b"therein", b"the", b"thereby"):
        t.count(w)
    assert t.computed == len(b"therein") + len(b"by")
    assert abs(sum(map(math.exp, SCORES.values())) - 1) < 1e-9


def test_query_columns(spark, sf, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + [(None, None), (1, ""), (1, ""), (2, "é" * 5000)]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_tokens int")
    split = regex.compile(public_tokenizers.PATTERN).findall
    want = []
    for i, t in rows:
        found = [viterbi(w.encode()) for w in split(t or "")]
        want.append((str(i), len(found), sum(n for n, _ in found), round(sum(s for _, s in found), 6)))
    got = token_counts.count(df, PATH, public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "n_pretokens", "n_tokens", "log_prob"]
    assert sorted((str(r[0]), r[1], r[2], round(r[3], 6)) for r in got.collect()) == sorted(want)
    assert token_counts.count(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    monkeypatch.setattr(token_counts, "MOST_NODES", 5)
    t = token_counts.ForwardTrie(SCORES)
    assert [t.count(w) for w in (b"alpha", b"beta", b"alphabet")] == [viterbi(w) for w in (b"alpha", b"beta", b"alphabet")]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="theringaond", min_size=60, max_size=400))
def test_long_words_beyond_what_the_trie_stores(text):
    t = token_counts.ForwardTrie(SCORES)
    n, s = viterbi(text.encode())
    got = t.count(text.encode())
    assert got[0] == n and abs(got[1] - s) < 1e-9 and t.nodes <= token_counts.STORED


def test_ten_megabytes_without_a_space():
    c = token_counts.Counter(PATH, public_tokenizers.PATTERN)
    text = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(100_000)) * 100
    c.of("warm up")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    pretokens, tokens, _ = c.of(text)
    assert pretokens == 1 and 10_000_000 / c.trie.longest < tokens < 10_000_000 and len(c) < 5
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 150_000  # KB
