"""A tool server over standard input and output: JSON-RPC 2.0, a message a line, with search, index and reindex tools."""

from __future__ import annotations

import json
import os
import sys
from typing import IO

from corvane import __version__, format
from corvane.plans.engine import Engine

LIMIT, MOST = 10, 50
_PURPOSE = """Find code in an indexed codebase. mode "semantic" takes a question in plain words and compares meanings; mode "keyword" takes identifiers and matches names and signatures of definitions. The answer lists matching definitions with path, lines, kind, name and signature, and with includeSnippet their source."""


def current(codebases: list[dict], path: str) -> dict | None:
    """The codebase with the longest root that holds the path."""
    fits = [c for c in codebases if path == c["root_path"] or path.startswith(c["root_path"] + "/")]
    return max(fits, key=lambda c: len(c["root_path"]), default=None)


class ToolServer:
    def __init__(self, engine: Engine, cwd: str | None = None):
        self.engine, self.cwd = engine, cwd or os.getcwd()
        self.description = self.describe()

    def describe(self) -> str:
        c = current(self.engine.list_codebases(), self.cwd)
        return (f"This project ({c['root_path']}) is indexed: {c['chunk_count']} chunks from {c['file_count']} files.\n\n" if c else "") + _PURPOSE

    def tools(self) -> list[dict]:
        folder = {"type": "object", "properties": {"directory": {"type": "string", "description": "absolute path of the directory"}}, "required": ["directory"]}
        query = {
            "type": "object",
            "properties": {
                "query": {"type": "string"},
                "mode": {"type": "string", "enum": ["semantic", "keyword"], "default": "semantic"},
                "limit": {"type": "integer", "minimum": 1, "maximum": MOST, "default": LIMIT},
                "includeSnippet": {"type": "boolean", "default": True},
            },
            "required": ["query"],
        }
        return [
            {"name": "corvane_search", "title": "Search code", "description": self.description, "inputSchema": query},
            {"name": "corvane_index", "title": "Index a directory", "description": "Chunk and embed the source files of a directory so that they can be searched. Unchanged files are skipped.", "inputSchema": folder},
            {"name": "corvane_reindex", "title": "Bring the index up to date", "description": "After files changed: process only those that did. Best called at the end of a task that edits source files.", "inputSchema": folder},
        ]

    def call(self, name: str, a: dict) -> str:
        if name == "corvane_search":
            mode, limit = a.get("mode", "semantic"), a.get("limit", LIMIT)
            if not isinstance(a.get("query"), str) or mode not in ("semantic", "keyword") or not isinstance(limit, int) or not 1 <= limit <= MOST:
                raise ValueError(f"query must be a string, mode semantic or keyword, limit from 1 to {MOST}")
            found = self.engine.search(a["query"], limit=limit, include_snippet=a.get("includeSnippet", True), mode=mode)
            return format.tool_results(a["query"], mode, found, [] if found else self.engine.list_codebases())
        if name in ("corvane_index", "corvane_reindex"):
            r = self.engine.index(a["directory"])
            self.description = self.describe()
            return format.tool_index(r, name == "corvane_reindex")
        raise ValueError(f"no tool {name}")

    def handle(self, m: dict) -> list[dict]:
        """Messages in answer to one."""
        if "id" not in m:
            return []
        reply = {"jsonrpc": "2.0", "id": m["id"]}
        method, params = m.get("method"), m.get("params") or {}
        if method == "initialize":
            return [reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {"listChanged": True}}, "serverInfo": {"name": "corvane", "version": __version__}}}]
        if method == "ping":
            return [reply | {"result": {}}]
        if method == "tools/list":
            return [reply | {"result": {"tools": self.tools()}}]
        if method == "tools/call":
            before = self.description
            try:
                result = {"content": [{"type": "text", "text": self.call(params.get("name", ""), params.get("arguments") or {})}]}
            except Exception as e:  # the caller gets the reason, the server goes on
                result = {"content": [{"type": "text", "text": str(e)}], "isError": True}
            changed = [{"jsonrpc": "2.0", "method": "notifications/tools/list_changed"}] if self.description != before else []
            return [reply | {"result": result}, *changed]
        return [reply | {"error": {"code": -32601, "message": f"no method {method}"}}]

    def serve(self, lines: IO[str] = sys.stdin, out: IO[str] = sys.stdout) -> None:
        for line in lines:
            if line.strip():
                try:
                    answers = self.handle(json.loads(line))
                except json.JSONDecodeError as e:
                    answers = [{"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}]
                for a in answers:
                    out.write(json.dumps(a, ensure_ascii=False) + "\n")
                    out.flush()
