import public_tokenizers
import tiktoken

import corpus_pipeline
from corvane.llm import bpe, langid, pii
from tests.llm.test_pii import brute
from tests.llm.test_simhash import slow


def test_run_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = [(9000, None, "en", "src0", 0), (9001, "12345 !!", "en", "src0", 8), (9002, "", None, None, 0), (9003, "The thing was with them by the house and a@b.org there.", None, None, 55), (9004, "мы не знаем этого языка и его слов, они чужие нам всем", "en", "src1", 54)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    rows = docs.collect()
    m = langid.fit(docs)
    rejected = m.predict([r.text for r in rows])[2]
    kept = [r for r, no in zip(rows, rejected) if not no]
    assert not {9000, 9001, 9002} & {r.doc_id for r in kept} and 9003 in {r.doc_id for r in kept}
    near = slow([(r.doc_id, r.text) for r in kept])
    first = {i for i, *_, c in near if i == c}
    kept = [r for r in kept if r.doc_id in first]
    spans = {i: s for i, *_, s, _, _ in brute([(r.doc_id, r.text) for r in kept])}
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert set(got) == first
    for r in kept:
        added = [{"start": int(s), "kind": 4, "end": int(e), "remove": False} for k, s, e in (x.split(":") for x in spans[r.doc_id].split(",") if x) if k == "term"]
        if not added:
            assert got[r.doc_id].ids == t.encode_ordinary(pii.redact(r.text, None))
        assert got[r.doc_id].round_trip and got[r.doc_id].n_tokens == len(got[r.doc_id].ids)
    assert "a@b.org" not in t.decode(got[9003].ids)


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("*", "1 as slot", "'x' as h")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
        assert stage(spark, docs.limit(0), "").count() == 0
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert sorted(map(str, mixed.collect())) == sorted(map(str, docs.collect()))


def test_encode_stage(spark):
    """The last stage: nulls, empty and repeated rows, clashing names, an empty table."""
    rows = [(1, "some text", "en", "src0", 9), (1, "some text", "en", "src0", 9), (None, None, None, None, None), (2, "", "en", None, 0), (3, "é 12 \n", "de", "src1", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as ids", "'x' as round_trip", "2 as n_tokens", "3 as __encoded")
    got = corpus_pipeline.encode(spark, docs, "")
    assert got.columns == ["doc_id", "source", "n_tokens", "ids", "round_trip"]
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert sorted((str(r.doc_id), str(r.source), r.ids, r.n_tokens, r.round_trip) for r in got.collect()) == sorted((str(i), str(s), t.encode_ordinary(x or ""), len(t.encode_ordinary(x or "")), True) for i, x, _, s, _ in rows)
    assert corpus_pipeline.encode(spark, docs.limit(0), "").count() == 0
