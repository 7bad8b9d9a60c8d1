"""Results as text and JSON."""

from __future__ import annotations

import json
from decimal import ROUND_HALF_UP, Decimal

_NAMES = {"chunk_key": "chunkKey", "file_path": "filePath", "start_line": "startLine", "end_line": "endLine", "codebase_id": "codebaseId", "file_hash": "fileHash", "chunk_count": "chunkCount", "indexed_at": "indexedAt"}


def plural(n: int, word: str) -> str:
    return f"{n} {word}{'' if n == 1 else 's'}"


def two_places(x: float) -> str:
    """Of the exact binary value, so 1.005 gives 1.00."""
    return str(Decimal(x).quantize(Decimal("0.01"), ROUND_HALF_UP))


def _row(r) -> dict:
    r = r if isinstance(r, dict) else vars(r)
    return {_NAMES.get(k, k): v for k, v in r.items()}


def results_json(query: str, results: list, elapsed_ms: int) -> str:
    return json.dumps({"query": query, "results": [_row(r) for r in results], "total": len(results), "elapsed_ms": elapsed_ms}, indent=2, ensure_ascii=False)


def results_text(query: str, results: list, elapsed_ms: int) -> str:
    head = f'{plural(len(results), "result")} for "{query}" ({elapsed_ms}ms)'
    blocks = []
    for i, r in enumerate(results, 1):
        title = " ".join(x for x in (r.kind, r.name) if x) if r.name else r.kind
        block = f"[{i}] {title} (score: {two_places(r.score)})\n    {r.file_path}:{r.start_line}-{r.end_line}"
        blocks.append(block + (f"\n    {r.signature}" if r.signature else ""))
    return "\n\n".join([head, *blocks])


def files_json(files: list[dict]) -> str:
    return json.dumps([_row(f) for f in files], indent=2, ensure_ascii=False)


def files_text(files: list[dict]) -> str:
    if not files:
        return "No files indexed. Index a directory first."
    total = sum(f["chunk_count"] for f in files)
    return "\n".join([f"{plural(len(files), 'file')} indexed ({total} chunks):", "", *[f"  {f['file_path']} ({f['chunk_count']} chunks)" for f in files]])


def index_line(r) -> str:
    return f"Indexed {plural(r.files, 'file')} → {r.chunks} chunks, embedded {r.embedded}, skipped {r.skipped} unchanged, removed {r.removed} stale ({r.duration}ms)"


def eta(seconds: float) -> str:
    if seconds < 1:
        return "<1s"
    s = round(seconds)
    return f"{s}s" if s < 60 else f"{s // 60}m {s % 60}s"


def tool_results(query: str, mode: str, results: list, codebases: list[dict]) -> str:
    """Text of a search tool's answer."""
    if not results and not codebases:
        return "Nothing is indexed yet. Call the index tool on the project's directory once, then search again."
    if not results:
        return f'No results found for "{query}" (mode: {mode}). Indexed codebases: {", ".join(c["root_path"] for c in codebases)}'
    out = []
    for i, r in enumerate(results, 1):
        entry = f"{i}. {r.file_path}:{r.start_line}-{r.end_line}  [{r.kind}] {r.name}"
        entry += f"\n   {r.signature}" if r.signature else ""
        out.append(entry + (f"\n```\n{r.snippet}\n```" if r.snippet else ""))
    return "\n\n".join(out)


def tool_index(r, again: bool = False) -> str:
    if again:
        lines = [f"Reindexed: {r.files} changed files, {r.skipped} unchanged", f"Removed: {r.removed} stale" if r.removed else "", f"Duration: {r.duration}ms"]
    else:
        lines = [f"Indexed {r.files} files → {r.chunks} chunks", f"Embedded: {r.embedded}, Skipped: {r.skipped} unchanged, Removed: {r.removed} stale", f"Duration: {r.duration}ms"]
    return "\n".join([x for x in lines if x] + ([f"Errors: {', '.join(r.errors)}"] if r.errors else []))
