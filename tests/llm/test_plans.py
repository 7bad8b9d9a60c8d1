"""Operators that work row by row shuffle nothing, and read only the columns that they need."""

import re

import pytest

from corvane.llm.queries import QUERIES

MAP_ONLY = {"op3_token_counts": {"doc_id", "text"}, "op5_language_id": {"doc_id", "text"}, "op7_url_filter": {"page_id", "url"}, "op8_bpe": {"doc_id", "text"}}


@pytest.mark.parametrize("name", sorted(MAP_ONLY))
def test_map_only(spark, tmp_path, name):
    for t in ("documents", "pages"):  # as many splits as cores, as in any large table
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").repartition(16).write.parquet(f"{tmp_path}/{t}.parquet")
    was = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "134217728")
    try:
        text = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", was)
    assert "Exchange" not in text
    assert [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<(.*)>", text)] == [MAP_ONLY[name]]
