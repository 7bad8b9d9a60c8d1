"""A directory tree of source files as a Spark data source: spark.read.format("source_tree").load(root)."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from corvane.functions.languages import detect
from corvane.schemas import SCANNED

#: Never entered or read, at any depth; neither is any name that starts with a dot.
IGNORED = frozenset("venv node_modules dist build target __pycache__ .venv .tox .rustup .next .mypy_cache .git .cargo".split())
LARGEST = 1_000_000
#: Files and bytes of a partition.
PART_FILES, PART_BYTES = 2000, 32_000_000


def ignore_patterns(content: str) -> set[str]:
    """Names of a .gitignore: lines that aren't blank, comments or hold a `*`, without one closing slash. Compared with bare names only."""
    lines = (line.strip() for line in content.split("\n"))
    return {line.removesuffix("/") for line in lines if line and not line.startswith("#") and "*" not in line} - {""}


def walk(root: str, languages: list[str] | None = None) -> Iterator[tuple[str, str, int, str | None]]:
    """(path, language, size, error) of the files to read, depth first, pruned before descent. Only the root's .gitignore counts; links are skipped."""
    root = os.path.abspath(root)
    names: set[str] = set()
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8", errors="replace") as f:
            names = ignore_patterns(f.read())
    except OSError:
        pass
    todo = [root]
    while todo:
        folder = todo.pop()
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            yield folder, "", 0, f"{folder}: {e.strerror or e}"
            continue
        below = []
        for entry in entries:
            if entry.name.startswith(".") or entry.name in IGNORED or entry.name in names:
                continue
            if entry.is_dir(follow_symlinks=False):
                below.append(entry.path)
                continue
            if not entry.is_file(follow_symlinks=False):
                continue
            language = detect(entry.name)
            if language is None or (languages and language.name not in languages):
                continue
            try:
                size = entry.stat(follow_symlinks=False).st_size
            except OSError as e:
                yield entry.path, language.name, 0, f"{entry.path}: {e.strerror or e}"
                continue
            if 0 < size <= LARGEST:
                yield entry.path, language.name, size, None
        todo += reversed(below)


def read_file(path: str) -> tuple[str, str]:
    """Content, bytes that aren't UTF-8 replaced, and the SHA-256 of this content."""
    if not stat.S_ISREG(os.lstat(path).st_mode):
        raise OSError("not a regular file")
    with open(path, "rb") as f:
        text = f.read().decode("utf-8", "replace")
    return text, hashlib.sha256(text.encode()).hexdigest()


class Files(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class TreeReader(DataSourceReader):
    """The driver lists names and sizes; contents are read and hashed where the partitions run."""

    def __init__(self, root: str, languages: list[str] | None):
        self.root, self.languages = os.path.abspath(root), languages

    def partitions(self) -> list[Files]:
        parts, rows, size = [], [], 0
        for row in walk(self.root, self.languages):
            rows.append(row)
            size += row[2]
            if len(rows) >= PART_FILES or size >= PART_BYTES:
                parts.append(Files(rows))
                rows, size = [], 0
        return [*parts, Files(rows)] if rows or not parts else parts

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, language, _, error in partition.rows:
            content = digest = None
            if error is None:
                try:
                    content, digest = read_file(path)
                except OSError as e:
                    error = f"{path}: {e.strerror or e}"
            yield path, os.path.relpath(path, self.root), language or None, digest, content, error


class SourceTree(DataSource):
    """Options: path (the root), languages (names joined by commas; all if unset)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> StructType:
        return SCANNED

    def reader(self, schema: StructType) -> TreeReader:
        languages = [x for x in self.options.get("languages", "").split(",") if x]
        return TreeReader(self.options["path"], languages or None)


def scan(spark: SparkSession, root: str, languages: list[str] | None = None):
    """Rows of SCANNED: a file with its content and hash, or an `error` without them."""
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("languages", ",".join(languages or [])).load(os.path.abspath(root))
