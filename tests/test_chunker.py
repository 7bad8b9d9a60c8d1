from pathlib import Path

import pytest

from corvane.chunk.chunker import ChunkFile, chunk_file, chunk_files
from corvane.functions.languages import BY_NAME, LANGUAGES, detect, kind_of, node_kind, supported_extensions

TREE = Path(__file__).parent / "fixtures" / "tree"


def chunks(name, text=None):
    text = (TREE / name).read_text() if text is None else text
    return [(c[3], c[4], c[7], c[8]) for c in chunk_file(f"/x/{name}", text, "h", detect(name))]


WANT = {
    "sample.rs": [("struct", "Basket", 5, 7), ("enum", "Fruit", 9, 12), ("impl", "Basket<T>", 14, 19), ("impl", "fmt::Display for Fruit", 21, 25), ("function", "pick", 27, 29), ("const", "LIMIT", 31, 31), ("static", "NAME", 32, 32), ("type", "Pair", 33, 33), ("macro", "twice", 34, 34)],
    "sample.js": [("function", "greet", 3, 3), ("function", "walk", 4, 4), ("class", "Shelf", 5, 5), ("variable", "limit", 6, 6), ("variable", "{ a, b }", 7, 7), ("variable", "", 8, 8), ("function", "shown", 9, 11), ("class", "", 13, 13)],
    "sample.ts": [("interface", "Shape", 1, 1), ("type", "Id", 2, 2), ("enum", "Tone", 3, 3), ("class", "Base", 4, 4), ("variable", "make", 5, 7), ("class", "Square", 8, 9)],
    "sample.tsx": [("function", "Card", 1, 3)],
    "sample.c": [("macro", "SIZE", 2, 2), ("function", "MAX", 3, 3), ("type", "point_t", 4, 4), ("struct", "node", 5, 5), ("enum", "color", 6, 6), ("declaration", "int", 7, 7), ("function", "add", 8, 10), ("function", "char", 11, 11)],
    "sample.py": [("function", "load", 7, 10), ("class", "Queue", 13, 15), ("class", "Item", 18, 20), ("function", "fetch", 23, 24)],
    "sample.go": [("type", "Cart", 5, 7), ("method", "*Cart.Add", 9, 11), ("function", "New", 13, 13), ("const", "First", 15, 18), ("variable", "total", 20, 20)],
    "sample.zig": [("variable", "std", 1, 1), ("function", "add", 2, 4), ("test", "adds two", 5, 7)],
    "Sample.java": [("class", "Sample", 3, 7), ("interface", "Priced", 8, 8), ("enum", "Size", 9, 9), ("record", "Point", 10, 10)],
    "sample.scala": [("class", "Book", 2, 2), ("object", "Main", 3, 5), ("trait", "Named", 6, 6), ("function", "twice", 7, 7), ("variable", "answer", 8, 8)],
    "sample.cpp": [("namespace", "shop", 2, 4), ("function", "largest", 5, 6), ("class", "Box", 7, 10), ("struct", "Pair", 11, 11), ("function", "Box_total", 12, 12)],
    "sample.php": [("interface", "Priced", 3, 3), ("trait", "Named", 4, 4), ("class", "Item", 5, 7), ("function", "total", 8, 8), ("enum", "Size", 9, 9)],
    "sample.cs": [("namespace_declaration", "Shop", 1, 6), ("interface", "IPriced", 7, 7), ("record", "Point", 8, 8), ("enum", "Size", 9, 9), ("struct", "Pair", 10, 10)],
    "sample.rb": [("variable", "LIMIT", 1, 1), ("module", "Shop", 2, 10), ("method", "total", 12, 16), ("method", "self.build", 18, 20)],
}


@pytest.mark.parametrize("name", WANT)
def test_definitions(name):
    assert chunks(name) == WANT[name]


def test_long_nodes_are_split_into_members():
    body = "\n".join(f"    x{i} = {i}" for i in range(160))
    py = f"@deco\nclass A:\n{body}\n    @property\n    def p(self): pass\n    def q(self): pass\n"
    assert [c[:2] for c in chunks("a.py", py)] == [("function", "p"), ("function", "q")]
    assert [c[:2] for c in chunks("a.py", f"class A:\n{body}\n")] == [("class", "A")]
    java = "class A {\n" + "  int a;\n" * 160 + "  A() { }\n  int f() { return 1; }\n}\n"
    assert [c[:2] for c in chunks("A.java", java)] == [("struct", "A"), ("method", "f")]
    rust = "impl A {\n" + "    // line\n" * 160 + "    fn f() {}\n    const K: u8 = 1;\n}\n"
    assert [c[:2] for c in chunks("a.rs", rust)] == [("function", "f"), ("const", "K")]
    cpp = "namespace n {\n" + "// line\n" * 160 + "int f() { return 1; }\ntemplate <class T> T g(T x) { return x; }\n}\n"
    assert [c[:2] for c in chunks("a.cpp", cpp)] == [("function", "f"), ("template", "g")]
    ts = "export class A {\n" + "  // line\n" * 160 + "  run(): void { }\n}\n"
    assert [c[:2] for c in chunks("a.ts", ts)] == [("method", "run")]
    scala = "object A {\n" + "  // line\n" * 160 + "  def f = 1\n}\n"
    assert [c[:2] for c in chunks("a.scala", scala)] == [("object", "A")]
    fn = "fn f() {\n" + "    // line\n" * 160 + "}\n"
    assert [c[:2] for c in chunks("a.rs", fn)] == [("function", "f")]
    ruby = "class A\n" + "  # line\n" * 160 + "  def f\n  end\n  K = 1\nend\n"
    assert [c[:2] for c in chunks("a.rb", ruby)] == [("method", "f"), ("variable", "K")]


def test_rows():
    c = chunk_file("/a/b.py", "x = 1\n\n\ndef f():\r\n    pass\n", "hash", BY_NAME["python"])[0]
    assert c == ("/a/b.py", "/a/b.py:4:5", "python", "function", "f", "def f():", "def f():\r\n    pass", 4, 5, "hash")
    two = chunk_file("/a.js", "function a() {} function b() {}", "h", BY_NAME["javascript"])
    assert [x[1] for x in two] == ["/a.js:1:1"] * 2
    assert chunk_file("/a.py", "# nothing\n", "h", BY_NAME["python"]) == []


def test_registry(spark):
    assert len(LANGUAGES) == 14 and len(supported_extensions()) == 27
    assert detect("a/b.PY") is None and detect("Makefile") is None and detect("x.tar.go").name == "go" and detect("v.h").name == "c"
    assert node_kind("constructor_declaration") == "struct" and node_kind("preproc_function_def") == "function" and node_kind("namespace_declaration") == "namespace_declaration"
    types = sorted({t for x in LANGUAGES for t in x.top_level} | {"constructor", "odd"})
    got = spark.createDataFrame([(t,) for t in types], "t string")
    assert {r.t: r.k for r in got.select("t", kind_of(got.t).alias("k")).collect()} == {t: node_kind(t) for t in types}


def test_on_spark(spark):
    rows = [("/a.py", "python", "h", "def f(): pass\ndef g(): pass"), ("/b.py", "python", "h", "def ("), ("/c.py", "python", "h", "#"), ("/d.x", "cobol", "h", "x")]
    df = spark.createDataFrame(rows, "abs_path string, language string, hash string, content string")
    got = chunk_files(df).collect()
    assert [(r.file_path, r.name, r.seq) for r in got if r.ok is None] == [("/a.py", "f", 0), ("/a.py", "g", 1)]
    assert {r.file_path: r.ok for r in got if r.ok is not None} == {"/a.py": True, "/b.py": False, "/c.py": True}
    assert next(r.error for r in got if r.ok is False).startswith("/b.py: ")
    spark.udtf.register("chunk_file", ChunkFile)
    df.createOrReplaceTempView("files_to_chunk")
    sql = "select c.name from files_to_chunk f, lateral chunk_file(f.abs_path, f.content, f.hash, f.language) c where f.abs_path = '/a.py'"
    assert [r.name for r in spark.sql(sql).collect()] == ["f", "g"]
