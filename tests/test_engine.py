import hashlib
import io
import json
import os
import shutil
from pathlib import Path

import pytest

from corvane import cli, embed, format
from corvane.plans.engine import Engine, SearchResult, once_a_percent
from corvane.server import ToolServer
from corvane.sources import tree
from corvane.store import Store

TREE = Path(__file__).parent / "fixtures" / "tree"


def names(rows):
    return {os.path.basename(r.abs_path) for r in rows}


def test_ignore_patterns():
    assert tree.ignore_patterns("a\n\n# c\n b/ \n*.log\n/anchored\nx/y\n!neg\n/\n") == {"a", "b", "/anchored", "x/y", "!neg"}


def test_tree_source(spark, tmp_path):
    shutil.copytree(TREE, tmp_path / "t")
    root = tmp_path / "t"
    for d in ("node_modules", ".hidden", "skipped", "sub/build"):
        (root / d).mkdir(parents=True)
        (root / d / "x.py").write_text("a = 1")
    (root / ".gitignore").write_text("skipped/\nsample.zig\n*.rb\n")
    (root / ".dot.py").write_text("x")
    (root / "empty.py").write_text("")
    (root / "full.py").write_bytes(b"#" * 1_000_000)
    (root / "over.py").write_bytes(b"#" * 1_000_001)
    (root / "bad.py").write_bytes(b"# \xff\n")
    os.symlink(root / "sample.py", root / "link.py")
    rows = tree.scan(spark, str(root)).collect()
    assert names(rows) == {"sample.rs", "sample.js", "sample.ts", "sample.tsx", "sample.c", "sample.py", "sample.go", "Sample.java", "sample.scala", "sample.cpp", "sample.php", "sample.cs", "sample.rb", "__init__.py", "_private.py", "d.rs", "broken.py", "full.py", "bad.py"}
    bad = next(r for r in rows if r.abs_path.endswith("bad.py"))
    assert bad.content == "# �\n" and bad.hash == hashlib.sha256(bad.content.encode()).hexdigest() and bad.rel_path == "bad.py" and bad.error is None
    assert names(tree.scan(spark, str(root), ["rust"]).collect()) == {"sample.rs", "d.rs"}
    missing = tree.scan(spark, str(root / "nowhere")).collect()
    assert len(missing) == 1 and missing[0].error.startswith(str(root / "nowhere"))


def test_engine_from_first_index_to_last(spark, tmp_path):
    root = tmp_path / "code"
    shutil.copytree(TREE, root)
    e = Engine(spark, str(tmp_path / "db"), clock=lambda: 7)
    seen = []
    r = e.index(str(root), progress=lambda *x: seen.append(x))
    assert r.files == 17 and r.skipped == 0 and r.removed == 0 and r.chunks == r.embedded > 60
    assert len(r.errors) == 1 and "broken.py" in r.errors[0] and [s[0] for s in seen] == ["scan", "hash", "chunk", "embed", "cleanup", "fts"]
    files = {os.path.basename(f["file_path"]): f for f in e.list_files()}
    assert files["_private.py"]["chunk_count"] == 0 and "broken.py" not in files and files["sample.py"]["indexed_at"] == 7
    assert [(c["name"], c["file_count"], c["chunk_count"]) for c in e.list_codebases()] == [("code", 17, r.chunks)]

    again = e.index(str(root))
    assert (again.files, again.chunks, again.embedded, again.skipped, again.removed) == (0, 0, 0, 17, 0) and len(again.errors) == 1

    found = e.search("Basket add", mode="keyword", include_snippet=True)
    assert isinstance(found[0], SearchResult) and found[0].snippet and {f.name for f in found} >= {"Basket"}
    assert e.search("what is this", mode="keyword") == [] == e.search("the", mode="hybrid")
    sem = e.search("load path cached", limit=3)
    assert len(sem) == 3 and sem[0].score >= sem[-1].score and sem[0].snippet == ""
    hybrid = e.search("Queue push", mode="hybrid", limit=4)
    assert hybrid and hybrid[0].score <= 1 / 61 + 1e-12 and e.search("Queue push", mode="hybrid", threshold=0.5) == []
    assert e.search("cart", mode="keyword", threshold=1e9) == []

    (root / "sample.py").write_text("def fresh(): pass\ndef newer(): pass; x = 1\n")
    (root / "sample.go").unlink()
    (root / "sub" / "broken.py").write_text("def mended(): pass")
    r = e.index(str(root))
    assert (r.files, r.chunks, r.embedded, r.skipped, r.removed, r.errors) == (2, 3, 3, 15, 1, [])
    assert {f.name for f in e.search("fresh", mode="keyword")} == {"fresh"}
    assert "sample.go" not in {os.path.basename(f["file_path"]) for f in e.list_files(str(root))}

    other = Engine(spark, str(tmp_path / "db"), embedder=lambda ts: [[1.0, 0.0] for _ in ts], embedding_model="flat")
    r = other.index(str(root))
    assert r.files == 0 and r.embedded == other.list_codebases()[0]["chunk_count"]

    r = e.index(str(root), ["rust"])
    assert r.removed > 0 and {f["file_path"].rsplit(".")[-1] for f in e.list_files()} == {"rs"}
    e.remove_codebase(str(root))
    assert e.list_files() == [] and e.store.read("chunks").count() == 0


def test_nested_roots_take_rows_over(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.py").write_text("def outer(): pass")
    (tmp_path / "a" / "b" / "y.py").write_text("def inner(): pass")
    e = Engine(spark, str(tmp_path / "db"))
    e.index(str(tmp_path / "a"))
    e.index(str(tmp_path / "a" / "b"))
    ids = {os.path.basename(r.file_path): r.codebase_id for r in e.store.read("chunks").collect()}
    assert ids == {"x.py": 1, "y.py": 2}
    assert [c["file_count"] for c in e.list_codebases()] == [2, 1]
    twice = e._keyword(["inner"], 5).collect()
    assert len(twice) == 2  # the outer codebase's postings keep the row until it is indexed again


def test_two_definitions_on_a_line_count_twice_and_stay_once(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.js").write_text("function a() {} function b() {}")
    e = Engine(spark, str(tmp_path / "db"))
    r = e.index(str(tmp_path / "c"))
    assert r.chunks == 2 and e.list_files()[0]["chunk_count"] == 2
    assert [c.name for c in e.store.read("chunks").collect()] == ["b"]


def test_a_failed_commit_changes_nothing(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    rows = spark.createDataFrame([(1, "/r", "r", 0)], s.read("codebases").schema)
    s.commit(rows)
    bad = rows.selectExpr("id", "root_path", "raise_error('no') as name", "indexed_at")
    with pytest.raises(Exception):
        s.commit(bad)
    assert s.read("codebases").count() == 1 and s.manifest()["version"] == 1
    for _ in range(4):
        s.commit(rows)
    assert sum(x.is_dir() for x in os.scandir(s.path)) <= 2


def test_a_store_without_chunks_that_is_large_is_refused(spark, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path / "db"))
    e.store.commit(spark.createDataFrame([(1, "/r", "r", 0)], e.store.read("codebases").schema))
    assert e.search("x y z") == []
    monkeypatch.setattr(e.store, "size", lambda: 2_000_000)
    e._verified = False
    with pytest.raises(RuntimeError):
        e.search("x y z")
    with pytest.raises(ValueError):
        e.search("x", mode="odd")


def test_embedders():
    a, b, c = embed.hashing_embedder(["open the file", "open a file", ""])
    assert len(a) == 384 and abs(sum(x * x for x in a) - 1) < 1e-9 and sum(x * y for x, y in zip(a, b)) > 0.5 and not any(c)
    assert embed.hashing_embedder(["x y"]) == embed.hashing_embedder(["x y"])


R = [SearchResult("/a:1:2", "/a", "f", "function", "def f()", "", 1, 2, 1.005), SearchResult("/b:3:4", "/b", "", "struct", "", "code", 3, 4, 0.126)]


def test_formats():
    assert format.results_text("q", [], 3) == '0 results for "q" (3ms)'
    assert format.results_text("q", R, 3) == '2 results for "q" (3ms)\n\n[1] function f (score: 1.00)\n    /a:1-2\n    def f()\n\n[2] struct (score: 0.13)\n    /b:3-4'
    j = json.loads(format.results_json("q", R, 3))
    assert (j["query"], j["total"], j["elapsed_ms"], j["results"][0]["filePath"], j["results"][0]["startLine"]) == ("q", 2, 3, "/a", 1)
    assert format.tool_results("q", "keyword", R, []) == "1. /a:1-2  [function] f\n   def f()\n\n2. /b:3-4  [struct] \n```\ncode\n```"
    assert "is indexed yet" in format.tool_results("q", "keyword", [], []) and "/r" in format.tool_results("q", "keyword", [], [{"root_path": "/r"}])
    assert [format.eta(x) for x in (0.4, 5, 75)] == ["<1s", "5s", "1m 15s"]
    out = []
    p = once_a_percent(lambda *x: out.append(x))
    for i in range(1001):
        p("chunk", i, 1000)
    assert len(out) == 101


def test_cli_and_server(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "m.py").write_text("def handle_request(x):\n    return x\n")
    db = str(tmp_path / "db")

    def run(*args):
        out = io.StringIO()
        assert cli.main(["--db", db, *args], spark, out) == 0
        return out.getvalue()

    assert "No files indexed" in run("list")
    assert run("index", str(tmp_path / "p")).startswith("Indexed 1 file → 1 chunks, embedded 1, skipped 0 unchanged, removed 0 stale (")
    assert "1 file indexed (1 chunks):" in run("list") and json.loads(run("list", "--format", "json"))[0]["chunkCount"] == 1
    assert json.loads(run("search", "handle_request", "--mode", "keyword", "--snippet"))["results"][0]["name"] == "handle_request"
    assert "function handle_request" in run("search", "handle request", "--format", "text")

    s = ToolServer(Engine(spark, db), str(tmp_path / "p" / "deep"))
    assert "1 chunks from 1 files" in s.description
    ask = lambda method, **p: s.handle({"jsonrpc": "2.0", "id": 1, "method": method, "params": p})
    assert [t["name"] for t in ask("tools/list")[0]["result"]["tools"]] == ["corvane_search", "corvane_index", "corvane_reindex"]
    text = lambda answers: answers[0]["result"]["content"][0]["text"]
    assert "handle_request" in text(ask("tools/call", name="corvane_search", arguments={"query": "handle_request", "mode": "keyword"}))
    assert ask("tools/call", name="corvane_search", arguments={"query": "x", "mode": "hybrid"})[0]["result"]["isError"]
    assert ask("tools/call", name="corvane_search", arguments={"query": "x", "limit": 51})[0]["result"]["isError"]
    (tmp_path / "p" / "n.py").write_text("def more(): pass")
    answers = ask("tools/call", name="corvane_reindex", arguments={"directory": str(tmp_path / "p")})
    assert text(answers).startswith("Reindexed: 1 changed files, 1 unchanged") and len(answers) == 2
    assert "Embedded: 0, Skipped: 2 unchanged" in text(ask("tools/call", name="corvane_index", arguments={"directory": str(tmp_path / "p")}))
    out = io.StringIO()
    s.serve(io.StringIO('{"id": 1, "method": "ping"}\nnot json\n{"method": "notifications/initialized"}\n{"id": 2, "method": "odd"}\n'), out)
    assert [("result" in m, m.get("error", {}).get("code")) for m in map(json.loads, out.getvalue().splitlines())] == [(True, None), (False, -32700), (False, -32601)]


def test_embedding_goes_on_where_it_died(spark, tmp_path, monkeypatch):
    """Rounds of a few chunks, of which one fails: those before are stored, and the next run embeds only the others."""
    from corvane.plans import engine as module

    monkeypatch.setattr(module, "EMBED_ROUND", 10)
    root = tmp_path / "t"
    shutil.copytree(TREE, root)
    flag = tmp_path / "fail"

    def embedder(texts):
        if flag.exists() and any("Queue" in t for t in texts):
            raise RuntimeError("no more")
        return [[1.0, float(len(t))] for t in texts]

    flag.touch()
    e = Engine(spark, str(tmp_path / "db"), embedder, "m")
    with pytest.raises(Exception, match="no more"):
        e.index(str(root))
    rows = e.store.read("chunks").collect()
    stored = sum(r.embedding is not None for r in rows)
    flag.unlink()
    told = []
    again = Engine(spark, str(tmp_path / "db"), embedder, "m").index(str(root), progress=lambda *x: told.append(x))
    assert len(rows) > 10 and again.chunks == 0 and again.embedded == len(rows) - stored
    assert all(r.embedding is not None for r in e.store.read("chunks").collect())
    rounds = [x for x in told if x[0] == "embed"]
    assert rounds[-1] == ("embed", again.embedded, again.embedded) and len(rounds) > 1
