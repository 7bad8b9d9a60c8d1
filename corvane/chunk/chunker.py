"""Definitions of a source file as chunks; the rules stand on nodes, whatever parser made them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf

from corvane.chunk.nodes import Node, parse
from corvane.functions.languages import BY_NAME, Language, node_kind
from corvane.schemas import CHUNK

MAX_CHUNK_LINES = 150


def chunk_file(path: str, content: str, file_hash: str, language: Language) -> list[tuple]:
    """Rows of CHUNK. A node stays whole up to 150 lines or where its type can't be split; else its members are taken, or it whole if it has none."""
    lines = content.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    out: list[tuple] = []

    def row_of(offset: int) -> int:
        lo, hi = 0, len(lines) - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if starts[mid] <= offset else (lo, mid - 1)
        return lo

    def emit(node: Node, kind: str) -> None:
        a, b = row_of(node.start) + 1, row_of(max(node.start, node.end - 1)) + 1
        out.append((path, f"{path}:{a}:{b}", language.name, kind, node.name, lines[a - 1].strip(), content[node.start : node.end], a, b, file_hash))

    def small(node: Node) -> bool:
        return row_of(max(node.start, node.end - 1)) - row_of(node.start) + 1 <= MAX_CHUNK_LINES

    def is_member(kind: str) -> bool:
        return kind in language.top_level or any(w in kind for w in ("function", "method", "constructor"))

    def split(node: Node, outer: Node) -> None:
        members = [m for m in node.children if is_member(m.type)]
        for m in members:
            emit(m, node_kind(m.type))
        if not members:
            emit(outer, node_kind(node.type))

    for node in parse(content, language.name):
        inner = node.inner
        if node.type == "export_statement":
            if inner and inner.type in language.top_level:
                emit(node, node_kind(inner.type)) if small(node) or inner.type not in language.splittable else split(inner, node)
            elif inner and ("function" in inner.type or "class" in inner.type):
                emit(node, node_kind(inner.type))
        elif node.type in ("decorated_definition", "template_declaration") and inner:
            emit(node, node_kind(inner.type)) if small(node) or inner.type not in language.splittable else split(inner, node)
        elif node.type in language.top_level:
            emit(node, node_kind(node.type)) if small(node) or node.type not in language.splittable else split(node, node)
    return out


CHUNKED = "file_path string, chunk_key string, language string, kind string, name string, signature string, snippet string, start_line int, end_line int, file_hash string, seq long, error string, ok boolean"


def chunk_files(files: DataFrame) -> DataFrame:
    """Files (abs_path, language, hash, content) to chunks with `seq` (their order in the file), and one row a file with `ok` set.

    A file that can't be parsed gives one row with `error`; one without definitions only its own row. Unknown languages give nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*CHUNK.names, "seq", "error", "ok"]
        for b in batches:
            rows = []
            for path, lang, h, content in zip(b["abs_path"], b["language"], b["hash"], b["content"]):
                if lang not in BY_NAME:
                    continue
                head = (path, None, lang, *[None] * 6, h, None)
                try:
                    found = chunk_file(path, content or "", h, BY_NAME[lang])
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append((*head, f"{path}: {e}", False))
                    continue
                rows.append((*head, None, True))
                rows += [(*c, i, None, None) for i, c in enumerate(found)]
            yield pd.DataFrame(rows, columns=names).astype({"start_line": "Int32", "end_line": "Int32", "seq": "Int64"})

    return files.select("abs_path", "language", "hash", "content").mapInPandas(run, CHUNKED)


@udtf(returnType=CHUNK)
class ChunkFile:
    """SELECT c.* FROM files, LATERAL chunk_file(abs_path, content, hash, language) c

    A file that can't be parsed gives no rows; chunk_files reports it.
    """

    def eval(self, path: str, content: str, file_hash: str, language: str):
        if language in BY_NAME:
            try:
                yield from chunk_file(path, content or "", file_hash, BY_NAME[language])
            except (SyntaxError, ValueError, RecursionError):
                return
