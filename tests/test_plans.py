"""What the plans must look like, whatever the size: pruned columns, pushed filters, no needless shuffle."""

import re

from corvane import schemas
from corvane.operators import catalogue, maintenance, search


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def columns_read(df):
    spark = df.sparkSession
    was = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        text = plan(df.select("*"))
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", was)
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<(.*)>", text)]


def chunks(spark, tmp_path):
    spark.createDataFrame([], schemas.CHUNKS).write.mode("overwrite").parquet(f"{tmp_path}/chunks")
    return spark.read.schema(schemas.CHUNKS).parquet(f"{tmp_path}/chunks")


def test_snippets_are_read_only_when_asked_for(spark, tmp_path):
    c = chunks(spark, tmp_path)
    top = spark.createDataFrame([("k", 0.5, 1)], "chunk_key string, score double, rank int")
    assert not any("snippet" in r or "embedding" in r for r in columns_read(search.with_chunks(top, c, False)))
    with_snippet = search.with_chunks(top, c, True)
    assert any("snippet" in r for r in columns_read(with_snippet)) and "BroadcastHashJoin" in plan(with_snippet)


def test_vector_search_reads_vectors_and_keeps_k_rows_a_partition(spark, tmp_path):
    top = search.vector_topk(chunks(spark, tmp_path).select("chunk_key", "embedding"), [1.0, 0.0], 5).select("chunk_key", "score")
    assert columns_read(top) == [{"chunk_key", "embedding"}] and "TakeOrderedAndProject" in plan(top) and "Exchange" not in plan(top)
    assert "IsNotNull(embedding)" in plan(top)


def test_a_threshold_stays_behind_the_limit(spark, tmp_path):
    df = search.over_threshold(search.vector_topk(chunks(spark, tmp_path), [1.0, 0.0], 5), 0.5)
    text = plan(df)
    assert re.search(r"Filter \(.*score", text).start() < text.index("TakeOrderedAndProject")


def test_filters_reach_the_scan(spark, tmp_path):
    c = chunks(spark, tmp_path)
    assert re.search(r"PushedFilters: \[.*EqualTo\(codebase_id,3\)", plan(catalogue.list_files(c.select("codebase_id", "file_path"), 3)))


def test_catalogue_sums_before_it_joins(spark, tmp_path):
    for name, schema in (("files", schemas.INDEXED_FILES), ("codebases", schemas.CODEBASES)):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}")
    f, c = spark.read.parquet(f"{tmp_path}/files"), spark.read.parquet(f"{tmp_path}/codebases")
    text = catalogue.list_codebases(c, f)._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Join LeftOuter") < text.index("Aggregate")  # the aggregate is below the join


def test_changed_files_is_an_anti_join(spark, tmp_path):
    f = chunks(spark, tmp_path)
    assert "LeftAnti" in maintenance.changed(f, f)._jdf.queryExecution().optimizedPlan().toString()
