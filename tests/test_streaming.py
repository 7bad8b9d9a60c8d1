from pyspark.sql import functions as F

from corvane.streaming.upserts import LatestTable, keep_latest


def test_latest_state_of_a_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    parts = events.select("user_id", "event_id", "event_type", "value").repartition(3)
    parts.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    t = LatestTable(f"{tmp_path}/table", ("user_id",), "event_id")
    keep_latest(stream, t, f"{tmp_path}/checkpoint").awaitTermination()
    want = events.groupBy("user_id").agg(F.max("event_id").alias("e")).collect()
    got = t.read(parts)
    assert {r.user_id: r.event_id for r in got.collect()} == {r.user_id: r.e for r in want}
    before = sorted(map(str, got.collect()))
    t.upsert(parts.limit(5).withColumn("value", F.lit(-1.0)), 0)  # a batch that was done before
    assert sorted(map(str, t.read(parts).collect())) == before


def test_a_batch_writes_only_its_own_buckets(spark, tmp_path):
    t = LatestTable(f"file:{tmp_path}/table", ("k",), "n", buckets=16)
    first = spark.range(200).selectExpr("id as k", "1 as n", "'a' as v")
    t.upsert(first, 0)
    before = {p.name: p for p in (tmp_path / "table").iterdir()}
    t.upsert(spark.createDataFrame([(7, 2, "b"), (7, 3, "c"), (500, 1, "d")], first.schema), 1)
    t.upsert(first.limit(0), 2)
    got = {r.k: (r.n, r.v) for r in t.read(first).collect()}
    assert got[7] == (3, "c") and got[500] == (1, "d") and len(got) == 201 and all(got[k] == (1, "a") for k in range(200) if k != 7)
    assert set(before) <= {p.name for p in (tmp_path / "table").iterdir()}  # the first version's other buckets are read on
