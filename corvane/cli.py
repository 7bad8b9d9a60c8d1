"""python -m corvane.cli [--db PATH] index DIR | search QUERY | list | serve"""

from __future__ import annotations

import argparse
import os
import sys
import time

from corvane import __version__, format
from corvane.store import project_path


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("corvane", description="Index source trees and search them.")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--db", help="folder of the tables (default: .corvane/index in the project)")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("index", help="index a directory")
    a.add_argument("dir")
    a.add_argument("--language", help="only files of this language")
    a.add_argument("--verbose", action="store_true")
    a = sub.add_parser("search", help="search what is indexed")
    a.add_argument("query")
    a.add_argument("--limit", type=int, default=5)
    a.add_argument("--threshold", type=float, default=0.0)
    a.add_argument("--format", choices=["json", "text"], default="json")
    a.add_argument("--snippet", action="store_true")
    a.add_argument("--mode", choices=["semantic", "keyword", "hybrid"], default="semantic")
    a = sub.add_parser("list", help="list the indexed files")
    a.add_argument("--format", choices=["json", "text"], default="text")
    sub.add_parser("serve", help="answer tool calls on standard input and output")
    return p


def _progress(phase: str, current: int, total: int) -> None:
    if sys.stderr.isatty():
        sys.stderr.write(f"\r\x1b[K{phase}" + (f" {current}/{total}" if total else ""))
        sys.stderr.flush()


def main(argv: list[str] | None = None, spark=None, out=None) -> int:
    out = out or sys.stdout
    a = parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("corvane").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    from corvane.plans.engine import Engine

    engine = Engine(spark, a.db or project_path(a.dir if a.command == "index" else os.getcwd()))
    if a.command == "index":
        r = engine.index(a.dir, [a.language] if a.language else None, _progress)
        for e in r.errors:
            print(f"warning: {e}", file=sys.stderr)
        print(format.index_line(r), file=out)
    elif a.command == "search":
        began = time.monotonic()
        found = engine.search(a.query, a.limit, a.threshold, a.snippet, a.mode)
        show = format.results_text if a.format == "text" else format.results_json
        print(show(a.query, found, round(1000 * (time.monotonic() - began))), file=out)
    elif a.command == "list":
        files = engine.list_files()
        print(format.files_json(files) if a.format == "json" else format.files_text(files), file=out)
    else:
        from corvane.server import ToolServer

        ToolServer(engine).serve()
    return 0


if __name__ == "__main__":
    sys.exit(main())
