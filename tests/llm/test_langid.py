import math
import zlib

import numpy as np

from corvane.llm import langid


def test_accuracy_on_held_out_documents(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) == 0


def test_odd_rows(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(None, "the thing of it", None), (-1, None, "en"), (-2, "", "en"), (-3, "123 !!", "fr"), (-4, "мы не знаем этого языка и его слов, они чужие нам всем", None), (-5, "the " * 40_000, None), (-5, "the " * 40_000, None)], docs.schema)
    both = docs.union(odd).selectExpr("*", "1 as score", "'x' as rejected", "2 as h")
    got = {}
    for r in langid.identify(both).where("doc_id is null or doc_id < 0").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [got[i][0].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and got[-1][0].score == 0
    assert got[None][0].lang_pred == "en" and not got[None][0].held_out
    assert got[-4][0].rejected and got[-4][0].lang_pred != "und"
    assert len(got[-5]) == 2 and got[-5][0] == got[-5][1]
    kept = langid.keep_identified(both)
    assert kept.columns == both.columns
    assert {r.doc_id for r in kept.where("doc_id is null or doc_id < 0").collect()} >= {None}
    assert kept.where("doc_id in (-1, -2, -3, -4)").count() == 0


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(empty).columns == ["doc_id", "held_out", "lang_pred", "score", "rejected"]
    assert langid.identify(empty).count() == 0
    one = langid.identify(spark.createDataFrame([(1, "some text", None)], empty.schema)).first()
    assert (one.lang_pred, one.score) == ("und", 0.0)


def test_counts_are_those_of_the_whole_text():
    a, b = langid.trigram_counts("abc def"), langid.trigram_counts("ABC -- def!")
    assert (a == b).all() and a.sum() == 7
    t = "word " * 300_000
    assert langid.trigram_counts(t).sum() == len(t) - 1


def test_every_length_can_be_rejected():
    import pandas as pd

    d = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").dropna(subset=["lang", "text"])
    d = d[d.text.map(langid.has_letter)]
    short = [langid.trigram_counts(p) for i, t in zip(d.doc_id, d.text) for p in langid.pieces(t, i)]
    m = langid.train(list(d.lang), np.stack([langid.trigram_counts(t) for t in d.text]), short=np.stack(short))
    assert (m.least > 0).all()
    rng = np.random.default_rng(1)
    noise = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, 7))) for _ in range(n))
    foreign = ["мы не знаем", "мы не знаем этого языка", "мы не знаем этого языка. " * 500, "我们不认识这种语言", noise(3000), noise(30_000)]
    assert m.predict(foreign)[2].tolist() == [True] * len(foreign)
    own = [" ".join(d.text), *[t for i, t in zip(d.doc_id, d.text) if i % 50 == 0], "the thing of it"]
    assert not m.predict(own)[2].any()


def test_against_a_slow_nearest_centroid(spark):
    """Trigrams counted one by one, every cosine a sum over a dictionary."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    m = langid.fit(docs)
    texts = [r.text for r in docs.collect()][:60] + ["Ä-ö 12 ß", "x", "the the", "нет", "e" * 5000, " \n", "12"]

    def slow(text):
        letters = "".join(chr(b) if 97 <= b <= 122 or b >= 128 else " " for b in text.lower().encode())
        padded = " " + " ".join(letters.split()) + (" " if letters.split() else "")
        tf = {}
        for k in range(len(padded) - 2):
            a, b, c = map(ord, padded[k : k + 3])
            at = ((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> (32 - langid.BITS)
            tf[at] = tf.get(at, 0) + 1
        v = {at: math.log(1 + n) * m.idf[at] for at, n in tf.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        cosines = [sum(x * c[at] for at, x in v.items()) / norm for c in m.centroids.astype(float)]
        best = max(range(len(cosines)), key=lambda i: cosines[i])
        return m.languages[m.language_of[best]], cosines[best], cosines[best] < m.least[min(int(math.log2(len(tf) + 1)), len(m.least) - 1)]

    lang, score, rejected = m.predict(texts)
    for t, *got in zip(texts, lang, score, rejected):
        want = slow(t) if any(map(str.isalpha, t)) else ("und", 0.0, True)
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-5 and got[2] == want[2], t[:40]


def test_many_dirty_languages(spark):
    rows = [(k, f"some words of text number {k} {chr(97 + k % 26) * 3}", f"dirty{k}" if k % 3 else "en") for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.fit(df, sample_total=50)
    assert len(m.languages) > 300 and len(m.centroids) <= 3 * len(m.languages)
    assert langid.identify(df, sample_total=50).count() == 900
