"""Folders on whatever file system Spark reads and writes: HDFS, an object store, a shared or a local disk."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder by Hadoop's file system interface. Paths without a scheme are those of the session's default file system, as in spark.read."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        own = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = own.getFileSystem(self._conf)
        self._own = self._fs.makeQualified(own)
        self.path = self._own.toString()
        self._fs.mkdirs(self._own)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._own, name)

    def of(self, name: str) -> str:
        return self._at(name).toString()

    def read(self, name: str) -> str | None:
        """A small file's text, None if there is none."""
        if not self._fs.exists(self._at(name)):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Put a small file in place of another, seen whole or not at all: written beside and renamed over it."""
        beside = self._at(f"_{uuid.uuid4().hex}")
        stream = self._fs.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._own.toUri(), self._conf).rename(beside, self._at(name), how)

    def delete(self, name: str) -> None:
        """With all that it holds; nothing happens if it isn't there."""
        self._fs.delete(self._at(name), True)

    def folders(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._own) if s.isDirectory()]

    def size(self, name: str) -> int:
        """Bytes of all files below."""
        return self._fs.getContentSummary(self._at(name)).getLength()
