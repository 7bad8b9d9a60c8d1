"""The stored tables as versioned Parquet: a commit writes new folders and then swaps one pointer file.

Readers see the version that the pointer names; a failed commit leaves it where it was. The pointer is written beside and renamed, which
is atomic on local disks and HDFS. A path with a scheme (hdfs://, s3a://) is used as it is, one without is a local folder, which must be
shared by all executors. Chunks and postings are partitioned by
codebase, so a commit writes the partitions of the codebases that it touches and takes the others over by name.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from corvane import schemas
from corvane.files import Folder

TABLES: dict[str, StructType] = {"codebases": schemas.CODEBASES, "chunks": schemas.CHUNKS, "indexed_files": schemas.INDEXED_FILES, "postings": schemas.POSTINGS, "field_stats": schemas.FIELD_STATS}
#: Versions that stay on disk, so that a running query can end on the one that it began with.
KEPT_VERSIONS = 2


class Store:
    """codebases is one folder; the other tables are one folder a codebase. `manifest` names them all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")
        self.path = self.folder.path.removeprefix("file:")

    @property
    def pointer(self) -> str:
        return self.folder.of("_current").removeprefix("file:")

    def manifest(self) -> dict:
        found = self.folder.read("_current")
        return json.loads(found) if found else {"version": 0, "codebases": None, "parts": {t: {} for t in TABLES if t != "codebases"}}

    def read(self, name: str, *codebase_ids: int) -> DataFrame:
        """A table of the current version, empty if there is none; with ids, only the folders of these codebases."""
        m = self.manifest()
        if name == "codebases":
            folders = [m["codebases"]] if m["codebases"] else []
        else:
            folders = [f for c, f in m["parts"].get(name, {}).items() if not codebase_ids or int(c) in codebase_ids]
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[self.folder.of(f) for f in folders])

    def _write(self, name: str, df: DataFrame) -> str:
        folder = f"{name}-{uuid.uuid4().hex}"
        df.select(*TABLES[name].names).write.parquet(self.folder.of(folder))
        return folder

    def commit(self, codebases: DataFrame | None = None, parts: dict[str, dict[int, DataFrame | None]] | None = None) -> None:
        """New contents of `codebases` and of tables by codebase (None: its folder goes), seen all at once or, on an error, not at all."""
        m = self.manifest()
        new: list[str] = []
        try:
            if codebases is not None:
                m["codebases"] = self._write("codebases", codebases)
                new.append(m["codebases"])
            for name, by in (parts or {}).items():
                for codebase_id, df in by.items():
                    m["parts"].setdefault(name, {}).pop(str(codebase_id), None)
                    if df is not None:
                        folder = self._write(name, df)
                        new.append(folder)
                        m["parts"][name][str(codebase_id)] = folder
        except BaseException:
            for folder in new:
                self.folder.delete(folder)
            raise
        m["version"] += 1
        m["history"] = [*m.get("history", []), sorted(self._folders(m))][-KEPT_VERSIONS:]
        self.folder.replace("_current", json.dumps(m))
        self._clean(m)

    def _folders(self, m: dict) -> set[str]:
        return {f for by in m["parts"].values() for f in by.values()} | ({m["codebases"]} if m["codebases"] else set())

    def _clean(self, m: dict) -> None:
        """Folders that no kept version names."""
        named = {f for v in m["history"] for f in v}
        for name in self.folder.folders():
            if name not in named and name.split("-")[0] in TABLES:
                self.folder.delete(name)

    def size(self) -> int:
        """Bytes on disk of the current version."""
        return sum(map(self.folder.size, self._folders(self.manifest())))


def now_ms() -> int:
    return int(time.time() * 1000)


def project_path(directory: str) -> str:
    """Where a project's tables are kept unless told otherwise."""
    return os.path.join(os.path.abspath(directory), ".corvane", "index")
