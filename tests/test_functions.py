from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions import vectors as vec


def test_keywords_of_prompts():
    assert tx.extract_keywords("How does the parser handle nested brackets?") == "parser handle nested brackets"
    assert tx.extract_keywords("look at retry-policy and max_size") == "look retry-policy max_size"
    assert tx.extract_keywords("cache Cache cache miss") == "cache miss"
    assert len(tx.extract_keywords(" ".join(f"word{i}" for i in range(40))).split()) == 12
    assert tx.extract_keywords("") == tx.extract_keywords("what is this and that") == ""
    assert tx.extract_keywords("don't Éole naïve " + "x" * 31) == "don ole"
    assert tx.preprocess_query("How is it?", "raw") == "How is it?" and tx.preprocess_query("the parser", "keywords") == "parser"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="abc -_.éÀB1'\n", max_size=40), max_size=20))
def test_keyword_column_is_the_function(spark, texts):
    rows = spark.createDataFrame([(t,) for t in [*texts, "the parser-state and the parser"]], "t string").select("t", tx.keywords(F.col("t")).alias("k")).collect()
    assert all(r.k == tx.extract_keywords(r.t) for r in rows)


def test_small_text_functions(spark):
    r = spark.createDataFrame([("\t x \r", "/a/b.tar.gz", None)], "t string, p string, n string").select(tx.trimmed(F.col("t")).alias("t"), tx.extension(F.col("p")).alias("e"), tx.last_segment(F.col("p")).alias("s"), tx.terms(F.col("n")).alias("n"), tx.keywords(F.col("n")).alias("k")).first()
    assert (r.t, r.e, r.s, r.n) == ("x", ".gz", "b.tar.gz", [])
    rows = [("p", "function", "f", "sig", "s" * 600), ("p", "k", "", "", ""), ("p", "", "n", "", "x")]
    got = spark.createDataFrame(rows, "a string, b string, c string, d string, e string").select(tx.embed_text(*map(F.col, "abcde")).alias("x")).collect()
    assert [x.x for x in got] == ["p: function f\nsig\n" + "s" * 500, "p", "p: n\nx"]


def test_cosine_and_quantising(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([1.0, 1.0],), (None,), ([0.0, 0.0],), ([1.0],)], "e array<float>")
    got = [r.s for r in df.select(vec.score(vec.cosine_to([2.0, 0.0])(F.col("e"))).alias("s")).collect()]
    assert got[0] == 1 and abs(got[1] - 0.5**0.5) < 1e-12 and got[2:] == [0, 0, 0]
    q = [r.q for r in df.select(vec.quantise(F.col("e")).alias("q")).collect()]
    assert q[0]["codes"] == [255, 0] and q[1]["codes"] == [0, 0] and q[1]["alpha"] == 0 and q[2] is None
