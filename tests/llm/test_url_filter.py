import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import url_filter


def regex_of(glob):
    return re.compile("".join({"**": "(?s:.*)", "*": "[^/]*"}.get(p) or re.escape(p) for p in re.split(r"(\*\*|\*)", glob)) + r"\Z")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="ab/*.é", max_size=40), min_size=1, max_size=9), st.lists(st.text(alphabet="ab/.é", max_size=70), min_size=1, max_size=9))
def test_globs_as_regular_expressions(globs, strings):
    globs = [re.sub(r"\*{2,}", "**", g) for g in globs]
    got = url_filter.Globs(globs).match([s.encode() for s in strings])
    assert got.tolist() == [[bool(regex_of(g).match(s)) for g in globs] for s in strings]


URLS = [None, "", "no scheme", "http://", "HTTPS://A.Example.ORG/es/x", "https://example.org/en/1", "https://example.org/en/2", "https://xexample.org/es/", "x://org", "x://org?/", "x://org/", "x://a.org:80/", "x://u@b.com/fr/?q", "x://b.com/fr", "x://b.com/de/#f", "x://b.com/FR/", "x://evil.net/a.org/es/", "x://É.com/de/ß", "x://a://b.org/", "x://n.net/a.png?x=/fr/", "x://ads.n.net/", "x://n.net/y/ads/z", "x://n.net/login", "x://m.net/" + "a" * 20_000 + ".exe", "x://n.net/l\nogin/ads/\n", "x://n.net/login"]


def test_against_sql(spark, sf):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    df = pages.union(spark.createDataFrame([(i if i else None, u) for i, u in enumerate(URLS)], "page_id long, url string")).selectExpr("*", "1 as host", "'r' as rule", "2 as g")
    got = url_filter.judge(df)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    pandas = df.select("page_id", "url").toPandas()
    con = duckdb.connect()
    con.register("pages", pandas.astype({"page_id": "Int64"}))
    want = con.execute(url_filter.oracle_sql()).fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.collect())) == sorted(map(key, want))
    assert {r[3] for r in want} >= {"org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None}
    assert url_filter.judge(df.limit(0)).count() == 0
