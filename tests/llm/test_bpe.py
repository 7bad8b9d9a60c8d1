import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
B = bpe.PrefixBPE(RANKS)
T = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
E = bpe.TextEncoder(PATH, public_tokenizers.PATTERN)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aeinrst h'.\n1", max_size=80)))
def test_as_tiktoken(text):
    assert E.encode(text) == T.encode_ordinary(text)
    assert B.decode(E.encode(text)) == text.encode()


def test_every_code_point_splits_as_tiktoken_does():
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    wrong = []
    for c in points:
        t = f"a{chr(c)}1 {chr(c)} b"
        if E.encode(t) != T.encode_ordinary(t):
            wrong.append(c)
    assert wrong == []


def test_appends_and_edits():
    rng = np.random.default_rng(4)
    for _ in range(30):
        data = bytes(rng.choice(list(b"theringaond 's"), 120))
        e = bpe.Edited(B, data[:50])
        e.append(data[50:])
        assert e.ids == B.ids(data, B.extend(data, []))
        a, b = sorted(rng.integers(0, 120, 2))
        e.replace(int(a), int(b), new := bytes(rng.choice(list(b"xthe "), int(rng.integers(0, 9)))))
        data = data[:a] + new + data[b:]
        assert e.data == data and e.ids == B.ids(data, B.extend(data, []))
    far = bpe.Edited(B, b" the thing was here" * 400)
    assert far.replace(20, 21, b"q") < 400


def test_query_columns(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(None, None), (7, ""), (7, ""), (8, "a" * 50_000), (9, " " * 3000 + "x")]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, ids string, x int")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((str(i), len(ids := T.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in rows)
    got = bpe.digests(df, PATH, public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want
    assert bpe.digests(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_ids_and_back(spark):
    df = spark.createDataFrame([(1, "Où est-ce ?"), (2, None)], "doc_id long, text string")
    back = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    assert [r.decoded for r in back] == ["Où est-ce ?", ""]


def test_a_missing_byte_raises():
    with pytest.raises(ValueError):
        bpe.PrefixBPE({b"a": 0}).encode(b"b")
