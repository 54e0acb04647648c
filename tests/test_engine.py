"""Trees, search, symbols, questions and refresh on small fixtures."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from lexquarry.engine import CorpusEngine, clean_path
from lexquarry.operators import corpus as tables
from lexquarry.operators import extract, search, xref
from lexquarry.operators.corpus import Corpus
from lexquarry.plans import ask
from lexquarry.sources import fstree, scip
from lexquarry.streaming.refresh import TABLES, Generations, build, classify, follow

TREE = {
    "README.md": "memory server readme",
    "server_notes.md": "server",
    "docs/guide.txt": "hello guide\nheader\nalpha beta gamma\nfooter",
    "pkg/service.py": 'class IndexStore:\n    """Keeps things."""\n\n    def rebuild_index(self, x: int) -> int:\n        return helper(x)\n\n\ndef helper(x):\n    return IndexStore\n',
    "tests/test_service.py": "from pkg.service import IndexStore\n\n\ndef test_rebuild():\n    store = IndexStore\n    store().rebuild_index(1)\n",
    "tests/api/x.txt": "x",
    "main.c": '#include <stdio.h>\n#include "util.h"\n#define MAX_BUFFER 10\n\nint send_data(int a) {\n  printf("x");\n  return strlen("y");\n}\n',
    "__pycache__/a.pyc": "no",
    "node_modules/m.js": "no",
}


def make(root, files):
    for p, t in files.items():
        os.makedirs(os.path.dirname(f"{root}/{p}") or root, exist_ok=True)
        with open(f"{root}/{p}", "w") as f:
            f.write(t)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    make(root, TREE)
    os.symlink(root / "README.md", root / "link.md")
    e = CorpusEngine.from_tree(spark, str(root))
    e.corpus.cache()
    return e


def paths(df):
    return [r["path"] for r in df.collect()]


def test_scan_and_totals(engine, spark):
    kinds = {r["path"]: r for r in engine.corpus.entries.collect()}
    assert kinds["."]["entry_type"] == "directory" and kinds["link.md"]["entry_type"] == "symlink" and kinds["link.md"]["symlink_target"]
    assert not any("pycache" in p or "node_modules" in p for p in kinds)
    assert kinds["docs/guide.txt"]["suffix"] == ".txt" and kinds["docs/guide.txt"]["mime_type"] == "text/plain" and kinds["tests"]["children_count"] == 2
    t = tables.totals(engine.corpus.entries).first()
    assert (t["total_files"], t["total_directories"], t["total_symlinks"]) == (7, 5, 1)
    assert t["total_size_bytes"] == sum(len(v.encode()) for p, v in TREE.items() if p[0] not in "_n")
    everything = engine.scan()
    assert "__pycache__/a.pyc" in paths(everything)
    assert paths(engine.corpus.entries.where(F.col("path").startswith("docs/"))) == ["docs/guide.txt"]
    with pytest.raises(FileNotFoundError):
        fstree.scan(spark, "/no/such/root")
    with pytest.raises(ValueError):
        fstree.resolve_requested(engine.root, "../escape")


def test_entry_children_stats(engine):
    assert engine.entry("./docs/guide.txt").first()["content_indexed"]
    assert paths(engine.children("tests")) == ["tests/api", "tests/test_service.py"]
    for call in (lambda: engine.entry("nothing"), lambda: engine.children("nothing")):
        with pytest.raises(FileNotFoundError):
            call()
    with pytest.raises(ValueError):
        engine.children("README.md")
    with pytest.raises(ValueError):
        clean_path(None)
    s = engine.index_stats().first().asDict()
    assert len(s) == 27 and s["text_files_indexed"] == 7 and s["python_test_symbol_count"] == 1 and len(s["ignored_names"]) == 13
    assert len(tables.stats(engine.corpus, ".", indexed=False).columns) == 25
    assert engine.health()["status"] == "ok"


@pytest.mark.parametrize("parts", [1, 3, 8, 1000])
def test_partitions_cover_the_tree_once(tmp_path, monkeypatch, parts):
    monkeypatch.setattr(fstree, "PARTS", parts)
    make(tmp_path, TREE | {f"big/{i % 3}/{i % 5}/{i}.txt": "x" for i in range(40)} | {"big/deep/a/b/c/d/e.txt": "y", "bigger/z.txt": "z"})
    os.symlink(tmp_path / "docs", tmp_path / "linked")
    ignored = frozenset(["node_modules"])
    want = {"."} | {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if "node_modules" not in p.parts}
    want = {p for p in want if not p.startswith("linked/")}
    listed = [r[0] for part in fstree._split(str(tmp_path), ignored) for r in fstree._read(str(tmp_path), ignored, part)]
    assert len(listed) == len(set(listed)) and set(listed) == want
    some = [r[0] for part in fstree._split(str(tmp_path), ignored, "big/1") for r in fstree._read(str(tmp_path), ignored, part)]
    assert len(some) == len(set(some)) and {p for p in want if p.startswith("big/1")} <= set(some) and "docs" not in some and "bigger" not in some
    assert len(fstree._split(str(tmp_path), ignored)) <= parts + 1


def test_worked_scores(spark, tmp_path):
    root = tmp_path / "proj"
    make(root, {"README.md": "memory server readme", "server_notes.md": "server"})
    c = build(spark, str(root))
    got = [(r["path"], round(r["score"], 6)) for r in search.search(c, "readme server").collect()]
    assert got == [("README.md", 2.329688), ("server_notes.md", 0.852228)]


def test_filters_and_limits(engine):
    assert paths(engine.search("guide", suffix="txt", path_prefix="docs")) == ["docs/guide.txt"]
    assert paths(engine.search("", content_query="beta")) == ["docs/guide.txt"]
    assert paths(engine.search(path_prefix=".")) == ["."]
    assert engine.search("readme", limit=0).count() == 0
    assert engine.search("", content_query="ж").count() == 0 and paths(engine.search("_pycache")) == []
    assert paths(engine.search("IndexStore")) == []  # queries are lower-cased before they are split
    assert set(paths(engine.search("", entry_type="directory", path_prefix="tests"))) == {"tests", "tests/api"}
    class_hits = engine.search("", content_query="class").collect()
    assert [(r["path"], r["score"]) for r in class_hits] == [("pkg/service.py", 0.0)]
    boosted = engine.search("", content_query="alpha beta", proximity=True).first()["score"]
    assert math.isclose(boosted - engine.search("", content_query="alpha beta").first()["score"], 0.75)


def test_ties_at_the_cut(spark):
    e = spark.createDataFrame([(f"{x}.txt", f"{x}.txt", "file", 1, ".txt") for x in "abcde"], "path string, name string, entry_type string, size_bytes long, suffix string").withColumn("mime_type", F.lit("text/plain"))
    c = Corpus(e, spark.createDataFrame([], "path string, text string"))
    assert paths(search.search(c, entry_type="file", limit=3)) == ["c.txt", "d.txt", "e.txt"]
    assert paths(search.search(c, entry_type="file", limit=9)) == [f"{x}.txt" for x in "abcde"]


def test_many_queries_equal_single_ones(engine):
    qs = ["readme server", "tests", "docs guide"]
    many = engine.search_many(qs, 3).collect()
    for i, q in enumerate(qs):
        one = [(r["path"], round(r["score"], 9)) for r in engine.search(q, limit=3).collect()]
        assert [(r["path"], round(r["score"], 9)) for r in sorted((r for r in many if r["qid"] == i), key=lambda r: r["rank"])] == one


def test_symbols_usages_tests(engine):
    assert [r["qualname"] for r in engine.symbols("rebuild_index").collect()] == ["IndexStore.rebuild_index"]
    assert [r["qualname"] for r in engine.symbols("ebuild").collect()] == ["IndexStore.rebuild_index", "test_rebuild"]
    assert engine.symbols("Store.reb").count() == 0  # the first three characters must be in a name
    assert engine.symbols("zz").count() == 0 and engine.symbols("", limit=100).count() == 9
    assert [r["kind"] for r in engine.symbols("helper", kind="function").collect()] == ["function"]
    u = engine.usages("IndexStore", limit=0).collect()
    assert len(u) == 1 and u[0]["path"] == "pkg/service.py" and u[0]["defines_symbol"]
    assert [(r["path"], r["count"]) for r in engine.usages("indexstore").collect()] == [("pkg/service.py", 1), ("tests/test_service.py", 1)]
    t = engine.related_tests("rebuild_index").collect()
    assert [(r["qualname"], r["score"]) for r in t] == [("test_rebuild", 3)]
    assert "line 4:     def [[rebuild]]_[[index]]" in engine.symbols("rebuild_index").first()["excerpt"]


def test_skeletons(engine):
    assert engine.skeleton("pkg/service.py").split("\n") == [
        "# FILE: pkg/service.py", "", "class IndexStore:", '  """Keeps things."""', "", "  # [L4-L5]", "  def rebuild_index(self, x: int) -> int:", "    # calls: helper (pkg/service.py:L8)",
        "    # used_by: test_rebuild (tests/test_service.py:L4)", "", "# [L8-L9]", "def helper(x):", "  # used_by: IndexStore.rebuild_index (pkg/service.py:L4)",
    ]
    assert engine.skeleton("README.md") == "# FILE: README.md\n\n# (no python symbols indexed in file)"
    assert "#include <stdio.h>" in engine.skeleton("main.c") and "# calls: printf, strlen" in engine.skeleton("main.c")
    assert engine.contour("helper").startswith("# CONTOUR: helper\n# FILE: pkg/service.py\n# [L8-L9]\ndef helper(x):")


def test_python_extraction():
    s, refs = extract.python_symbols("auth.py", 'import a.b as c, d.e\nfrom . import z\n@deco(1)\nasync def f(a, *, b: int = 2) -> str:\n    """Doc\n    more."""\n    def g(): return x.y.z(q)\n    return g()\nclass C(B, m.N):\n    class D:\n        def h(self): pass\n')
    assert [(x["qualname"], x["kind"]) for x in s] == [("c", "import"), ("e", "import"), ("z", "import"), ("f", "function"), ("f.g", "function"), ("C", "class"), ("C.D", "class"), ("C.D.h", "method")]
    f = s[3]
    assert f["signature"] == "(a, *, b: int=2) -> str" and f["docstring"] == "Doc\nmore." and f["calls"] == ["deco", "g", "x.y.z"] and s[5]["inherits"] == ["B", "m.N"]
    assert refs["z"] == 1 and "y" not in refs and "x" not in refs
    assert extract.python_symbols("bad.py", "def (") == ([], {})


class Node:
    """A node as the optional parser gives it."""

    def __init__(self, kind, text, line, end=None, children=(), **fields):
        self._kind, self._text, self._lines, self._children, self._fields = kind, text, (line, end or line), children, fields

    kind = lambda self: self._kind
    text = lambda self: self._text
    children = lambda self: list(self._children)
    field = lambda self, name: self._fields.get(name)

    def range(self):
        at = lambda n: type("At", (), {"line": n})()
        return type("Range", (), {"start": at(self._lines[0]), "end": at(self._lines[1])})()


def test_grammar_symbols(monkeypatch):
    import sys

    call = lambda name, line: Node("call_expression", f"{name}()", line, function=Node("identifier", name, line))
    inner = Node("function_definition", "int in()", 5, 6, [call("deep", 5)], declarator=Node("d", "*in(int a)", 5))
    outer = Node("function_definition", "int out()", 3, 8, [call("first", 4), inner, call("out", 7), call("first", 7)], declarator=Node("d", "out(int x)", 3))
    kids = [Node("struct_specifier", "struct P {}", 0, 1, name=Node("n", "P", 0)), outer, Node("preproc_include", '#include "util.h"', 9), Node("preproc_def", "#define LIMIT 3", 10), Node("preproc_def", "#define", 11), Node("enum_specifier", "enum {}", 12)]
    parser = type("Parser", (), {"SgRoot": lambda text, language: type("R", (), {"root": lambda self: Node("unit", text, 0, 12, kids)})()})
    monkeypatch.setitem(sys.modules, "ast_grep_py", parser)
    got, refs = extract.grammar_symbols("tests/a.c", "int (out) X1; x out x_y", "c")
    assert [(s["name"], s["kind"], s["line"], s["end_line"], s["calls"], s["is_test"]) for s in got] == [
        ("util.h", "include", 10, 10, [], False), ("LIMIT", "macro", 11, 11, [], False), ("macro", "macro", 12, 12, [], False),
        ("out", "function", 4, 9, ["first", "deep"], True), ("in", "function", 6, 7, ["deep"], True), ("P", "struct", 1, 2, [], False), ("struct_13", "enum", 13, 13, [], False),
    ]
    assert refs == {"int": 1, "out": 2, "x1": 1}


def test_c_quirks():
    s, refs = extract.c_symbols("tests/n.c", "class A : public B {\nint one() { return 1; }\nint x;\n};\nvoid two();\nint three()\n{\n}\nint four() { return NULL; }")
    assert [(x["qualname"], x["kind"], x["line"], x["end_line"]) for x in s] == [("A", "class", 1, 1), ("A.one", "method", 2, 3), ("A.two", "method", 5, 5)]
    assert s[0]["inherits"] == ["B"] and s[1]["is_test"] and refs["null"] == 1
    assert extract.extract("a.js", "class S {}") == ([], {}) or extract.extract("a.js", "class S {}")[0]


def test_questions(engine):
    p = ask.parse_question(engine.corpus, "show only directories inside tests")
    assert (p.intent, p.entry_type, p.path_prefix, p.query, p.limit) == ("search_files", "directory", "tests", "", 10)
    assert engine.ask("show only directories inside tests")["files"] == ["tests", "tests/api"]
    fallback = engine.ask("where function rebuild_index")
    assert fallback["parsed_query"]["symbol_kind"] == "function" and fallback["matches"][0]["kind"] == "method"
    ru = engine.ask("где класс IndexStore")
    assert ru["answer"] == "Class IndexStore определён в pkg/service.py:1" and ru["skeleton_dsl"].startswith("# CONTOUR: IndexStore")
    use = engine.ask("who uses IndexStore")
    assert use["parsed_query"]["intent"] == "find_usage" and use["files"] == ["pkg/service.py", "tests/test_service.py"]
    tests = engine.ask("tests for rebuild_index")
    assert tests["answer"] == "Нашёл тест для rebuild_index: test_rebuild в tests/test_service.py:4"
    readme = engine.ask("where is the readme file")
    assert readme["files"] == ["README.md"] and "[[readme]]" in readme["matches"][0]["excerpt"] and readme["answer"] == "Самый релевантный путь: README.md"
    assert engine.ask("find text about zebra")["answer"] == "Ничего не нашёл по запросу: find text about zebra"
    with pytest.raises(ValueError):
        engine.ask(" _?! ")


def test_scip(spark, tmp_path):
    doc = {"documents": [{"relative_path": "main.py", "language": "python", "occurrences": [{"symbol": "m", "symbol_roles": 1, "range": [1, 0, 1, 9]}, {"symbol": "u", "symbol_roles": 8, "range": [2, 1, 2]}]}, {"relative_path": "b.py", "occurrences": [{"symbol": "m", "symbol_roles": 3, "range": [5, 0, 1]}, {"symbol": "m"}]}]}
    (tmp_path / "x.json").write_text(json.dumps(doc))
    occ = scip.occurrences(spark, str(tmp_path / "x.json"))
    assert [tuple(r) for r in scip.definitions(occ).collect()] == [("m", "b.py", [5, 0, 1])]
    assert {(r["symbol"], r["relative_path"], tuple(r["range"])) for r in scip.references(occ).collect()} == {("u", "main.py", (2, 1, 2)), ("m", "b.py", (0, 0, 0, 0))}


def state(c):
    out = {}
    for k in TABLES:
        df = getattr(c, k)
        cols = [x for x in ("path", "name", "text", "qualname", "line", "cnt", "entry_type", "size_bytes") if x in df.columns]
        out[k] = sorted(map(str, df.select(cols).collect()))
    out["df"] = sorted(map(tuple, c.term_stats.collect()))
    return out


def test_refresh_equals_rebuild(spark, tmp_path):
    root, home = tmp_path / "r", tmp_path / "home"
    make(root, {k: TREE[k] for k in ("README.md", "pkg/service.py", "main.c")})
    g = Generations(spark, str(home))
    assert g.refresh(str(root))["mode"] == "full" and g.current == 1
    assert g.refresh(str(root)) == {"mode": "incremental", "added": 0, "modified": 0, "removed": 0} and g.current == 1
    make(root, {"new.py": "def fresh(): pass\n", "main.c": "#define OTHER 1\n"})
    os.remove(root / "README.md")
    delta = g.refresh(str(root))
    assert (delta["added"], delta["removed"]) == (1, 1) and delta["modified"] >= 1
    assert state(g.load()) == state(build(spark, str(root)))
    late, later = g.start(), g.start()
    assert g.publish(g.load(), later) and not g.publish(g.load(), late) and g.current == later
    make(root, {"again.txt": "seen by the stream"})
    q = follow(spark, str(root), str(home), every=None)
    q.awaitTermination(120)
    assert state(g.load()) == state(build(spark, str(root)))
    assert CorpusEngine.from_generation(spark, str(home)).search("again").count() == 1
    for p in sorted(root.rglob("*"), reverse=True):
        p.rmdir() if p.is_dir() else p.unlink()
    root.rmdir()
    assert g.refresh(str(root))["removed"] > 0 and g.load().entries.count() == 0


def test_engine_sees_edits(spark, tmp_path):
    """Tables show the tree as it was built; a refresh takes over edits, new and removed files, and equals a rebuild."""
    root = tmp_path / "r"
    make(root, {k: TREE[k] for k in ("README.md", "pkg/service.py", "main.c", "docs/guide.txt")})
    e = CorpusEngine.from_tree(spark, str(root)).cache()
    assert e.refresh() == {"mode": "incremental", "added": 0, "modified": 0, "removed": 0}
    make(root, {"docs/guide.txt": "walrus and carpenter", "pkg/service.py": "def other(): pass\n"})
    assert e.search(content_query="walrus").count() == 0 and e.search(content_query="gamma").count() == 1 and e.symbols("helper").count() == 1
    assert e.refresh() == {"mode": "incremental", "added": 0, "modified": 2, "removed": 0}
    assert paths(e.search(content_query="walrus")) == ["docs/guide.txt"] and e.search(content_query="gamma").count() == 0
    assert e.symbols("helper").count() == 0 and e.symbols("other").count() == 1
    os.remove(root / "README.md")
    make(root, {"new.txt": "fresh walrus"})
    delta = e.refresh()
    assert (delta["added"], delta["removed"]) == (1, 1)
    assert state(e.corpus) == state(build(spark, str(root)))
    assert set(paths(e.search(content_query="walrus"))) == {"docs/guide.txt", "new.txt"}


def test_classification(spark):
    mk = lambda rows: spark.createDataFrame(rows, "path string, signature long")
    got = {r["path"]: r["change"] for r in classify(mk([("a", 1), ("b", 1), ("c", None), ("d", None)]), mk([("b", 2), ("c", None), ("d", 1), ("e", 1)])).collect()}
    assert got == {"a": "removed", "b": "modified", "d": "modified", "e": "added"}


def test_references_resolve_to_the_first_of_five(engine):
    refs = engine.spark.createDataFrame([("pkg.helper",), ("unknown",), ("IndexStore",)], "ref string")
    got = {r["ref"]: r["resolved"] for r in xref.resolve_refs(engine.corpus, refs).collect()}
    assert got == {"pkg.helper": "pkg.helper (pkg/service.py:L8)", "unknown": "unknown", "IndexStore": "IndexStore (pkg/service.py:L1)"}


def test_service(engine):
    import threading
    import urllib.error
    import urllib.request
    from http.server import ThreadingHTTPServer

    from lexquarry.serve import Service, handler, tools

    server = ThreadingHTTPServer(("127.0.0.1", 0), handler(Service(engine)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def get(path, data=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, data=json.dumps(data).encode() if data is not None else None), timeout=120) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    assert get("/index/search?q=readme&limit=1")[1]["results"][0]["path"] == "README.md"
    assert get("/index/file?path=docs/guide.txt")[1]["content_indexed"] is True
    assert get("/index/file?path=none")[0] == 404 and get("/index/skeleton")[0] == 400 and get("/nowhere")[0] == 404
    assert get("/ramdisk/create", {})[0] == 409 and get("/ask", {"question": "?"})[0] == 400
    assert get("/index/children?path=tests")[1]["count"] == 2
    assert len(get("/")[1]["routes"]["GET"]) == 14 and len(get("/")[1]["routes"]["POST"]) == 4
    assert {x["path"] for x in get("/fs/tree")[1]["children"]} >= {"docs", "__pycache__"}
    server.shutdown()
    assert set(tools(engine)) == {"get_file_skeleton", "get_symbol_contour", "search_codebase", "ask_codebase", "get_index_stats"}
    assert tools(engine)["search_codebase"]("guide", 1)[0]["excerpt"].endswith("hello [[guide]]\n  line 2: header\n  line 3: alpha beta gamma\n  line 4: footer")
