"""A stream of changes kept as a table of the last state by key; the batch operators do the work of each micro-batch."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.files import Folder
from corvane.operators.maintenance import last_wins

#: Buckets of a new table, by a hash of the key.
BUCKETS = 64
_BUCKET = "__bucket"


class LatestTable:
    """Rows by key, the one with the highest `order` each; a batch that is delivered twice changes nothing.

    The table lies in buckets by a hash of the key. A batch reads and writes the buckets of its own keys only; a pointer file then names
    their new folders and the batch in one step.
    """

    def __init__(self, path: str, keys: tuple[str, ...], order: str, buckets: int = BUCKETS):
        self.path, self.keys, self.order, self.buckets = path, keys, order, buckets

    def _current(self, folder: Folder) -> dict:
        found = folder.read("_current")
        return json.loads(found) if found else {"batch": -1, "count": self.buckets, "buckets": {}}

    def _bucket(self, count: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(count)).cast("int")

    def _rows(self, spark: SparkSession, folder: Folder, like: DataFrame, names: list[str]) -> DataFrame:
        if not names:
            return spark.createDataFrame([], like.schema)
        return spark.read.schema(like.schema).parquet(*[folder.of(n) for n in names])

    def read(self, like: DataFrame) -> DataFrame:
        folder = Folder(like.sparkSession, self.path)
        return self._rows(like.sparkSession, folder, like, sorted(self._current(folder)["buckets"].values()))

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = Folder(spark, self.path)
        now = self._current(folder)
        if batch_id <= now["batch"]:
            return
        bucket = self._bucket(now["count"])
        touched = sorted(str(r[0]) for r in batch.select(bucket).distinct().collect())  # at most so many as there are buckets
        old = [now["buckets"][b] for b in touched if b in now["buckets"]]
        if touched:
            new = f"v-{uuid.uuid4().hex}"
            rows = last_wins(self._rows(spark, folder, batch, old).unionByName(batch), self.keys, self.order)
            rows.withColumn(_BUCKET, bucket).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(folder.of(new))
            now["buckets"] |= {b: f"{new}/{_BUCKET}={b}" for b in touched}
        folder.replace("_current", json.dumps(now | {"batch": batch_id}))
        for name in old:
            folder.delete(name)
        kept = {n.split("/")[0] for n in now["buckets"].values()}
        for name in folder.folders():
            if name.startswith("v-") and name not in kept:
                folder.delete(name)


def keep_latest(stream: DataFrame, table: LatestTable, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start upserting a stream into the table; with `available_now` it ends when all that is there is read."""
    writer = stream.writeStream.foreachBatch(table.upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
