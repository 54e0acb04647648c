"""Source files written from documents, graphs in parts, and references that only a looser match can find."""

import ast
import re

import pytest

from lexquarry.operators import xref
from lexquarry.operators.corpus import SYMBOLS, Corpus
from lexquarry.operators.extract import extract_all
from lexquarry.sources import fstree, scip
from lexquarry.sources.code import GROUP, code_of, graphs_of
from lexquarry.sources.tables import _entries

TEXTS = {0: None, 1: "", 2: "... 12", 3: "One", 4: "The Class def import " * 30, 5: 'a "quote" \\ \n\r  été ' * 25, 6: "w " * GROUP}


def _documents(spark):
    return spark.createDataFrame([(i, t, "src1", "en", "x") for i, t in TEXTS.items()], "doc_id long, text string, source string, lang string, path string")


def test_every_word_is_in_a_file_that_parses(spark):
    got = {int(r["path"][-6:-3]): r["text"] for r in code_of(_documents(spark)).collect()}
    assert set(got) == set(TEXTS)
    for i, t in TEXTS.items():
        words = re.findall("[a-z]+", (t or "").lower())
        tree = ast.parse(got[i])
        classes = [n for n in tree.body if isinstance(n, ast.ClassDef)]
        assert " ".join(ast.get_docstring(n) for n in classes) == " ".join(words)
        assert len(classes) == -(-len(words) // GROUP) and [n.lineno for n in classes] == [9 * k + 3 for k in range(len(classes))]
        assert len({n.name for n in classes}) == len(classes)


def test_empty_table(spark):
    none = _documents(spark).limit(0)
    assert code_of(none, ".c").count() == 0 and scip.definitions(scip.occurrences_of(graphs_of(none))).count() == 0


def test_symbols_of_both_languages(spark):
    for suffix, language, kinds in ((".py", "python", {"import", "class", "method", "function"}), (".c", "c", {"include", "macro", "struct", "function"})):
        symbols, refs = extract_all(code_of(_documents(spark), suffix))
        rows = symbols.collect()
        assert {r["kind"] for r in rows} == kinds and {r["language"] for r in rows} == {language}
        assert {int(r["path"].split("_")[-1].split(".")[0]) for r in rows} == {3, 4, 5, 6} and refs.count() > 0
        assert all(r["is_test"] for r in rows if r["path"].startswith("tests/") and r["kind"] in ("class", "method", "function"))


def test_graph_in_parts(spark):
    """The last definition counts over all parts; a part that isn't JSON, or null, has no occurrences."""
    part = lambda path, role: f'{{"documents": [{{"relative_path": "{path}", "occurrences": [{{"symbol": "s", "symbol_roles": {role}, "range": [1, 2, 3]}}]}}]}}'
    parts = spark.createDataFrame([(3, part("c.py", 8)), (2, part("b.py", 1)), (1, part("a.py", 1)), (4, "no json"), (5, None)], "ordinal long, value string")
    occ = scip.occurrences_of(parts)
    assert [tuple(r) for r in scip.definitions(occ).collect()] == [("s", "b.py", [1, 2, 3])]
    assert [r["relative_path"] for r in scip.references(occ).collect()] == ["c.py"]


def test_references_found_by_a_looser_match(spark):
    """`p.nabx`, imported as `nabxyz`, has no symbol of its short name; its qualified name is found by the characters that names share."""
    rows = [("nabxyz", "p.nabx", "a.py", 1, 0), ("other", "p.other", "a.py", 2, 1), ("prenab", "prenab", "b.py", 1, 0)]
    blank = {k.split(" ")[0]: k.split(" ", 1)[1] for k in (x.strip() for x in SYMBOLS.split(", "))}
    symbols = spark.createDataFrame(rows, "name string, qualname string, path string, line int, ordinal int")
    symbols = symbols.selectExpr(*[k if k in symbols.columns else f"cast(null as {t}) as {k}" for k, t in blank.items()])
    texts = spark.createDataFrame([("a.py", ""), ("b.py", "")], "path string, text string")
    c = Corpus(_entries(texts.selectExpr("path", "0L as size_bytes"), "code"), texts, symbols)
    refs = spark.createDataFrame([("p.nabx",), ("p.other",), ("nab",), ("gone.nab",), (None,)], "ref string")
    got = {r["ref"]: r["resolved"] for r in xref.resolve_refs(c, refs).collect()}
    assert got == {"p.nabx": "p.nabx (a.py:L1)", "p.other": "p.other (a.py:L2)", "nab": "nab", "gone.nab": "gone.nab"}


def test_files_are_written_whole(spark, tmp_path):
    root = tmp_path / "up" / "tree"
    texts = [("a/b.txt", "one\r\ntwo é"), ("a/c", None), ("d.md", "x" * 3_000_000), ("d.md", "x" * 3_000_000)]
    fstree.write_files(spark.createDataFrame(texts, "path string, text string").repartition(3), f"file://{root}")
    found = {str(p.relative_to(root)): p.read_bytes().decode() for p in root.rglob("*") if p.is_file()}
    assert found == {p: t or "" for p, t in texts}
    assert [p.name for p in root.parent.iterdir()] == ["tree"]
    with pytest.raises(Exception, match="escapes"):
        fstree.write_files(spark.createDataFrame([("../x", "")], "path string, text string"), str(root))
    assert not (root.parent / "x").exists()


def test_local_paths():
    assert [fstree.local_path(x) for x in ("/a/b", "file:/a/b", "file:///a b/c", "rel/x")] == ["/a/b", "/a/b", "/a b/c", "rel/x"]
    with pytest.raises(ValueError, match="not a mounted folder"):
        fstree.local_path("hdfs://host/a")


def _code(spark, files):
    texts = spark.createDataFrame(list(files.items()), "path string, text string")
    symbols, refs = extract_all(texts)
    return Corpus(_entries(texts.selectExpr("path", "0L as size_bytes"), "code"), texts, symbols, refs)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


SHOWN = {"a.py": "class A:\n    def f(self):\n        g()\nclass A:\n    pass\ndef g():\n    return A.f(1)\n", "b.py": "import g\ndef h():\n    g()\n", "c.py": "", "d.py": "import os\n"}


def test_lines_of_skeletons_move_by_path_once(spark):
    """symbols, references and callers were joined by path and ordinal, and lines of classes and members by path, name and kind, one shuffle each."""
    c = _code(spark, SHOWN)
    plan = _plan(xref.file_skeletons(c))
    moved = set(re.findall(r"hashpartitioning\(path#\d+, \w+", plan))
    assert not any(re.sub(r"#\d+", "", x).endswith((" ordinal", " name")) for x in moved), moved
    got = {r["path"]: r["skeleton"] for r in xref.file_skeletons(c).collect()}
    f = ["", "  # [L2-L3]", "  def f(self):", "    # calls: g (a.py:L6)", "    # used_by: g (a.py:L6)"]
    assert got["a.py"] == "\n".join(["# FILE: a.py", "", "class A:", *f, "", "class A:", *f, "", "# [L6-L7]", "def g():", "  # calls: A.f (a.py:L2)", "  # used_by: A.f (a.py:L2), h (b.py:L2)"])
    assert got["c.py"] == "# FILE: c.py\n\n# (no python symbols indexed in file)" and got["d.py"] == "# FILE: d.py\n"
    one = xref.file_skeletons(c, spark.createDataFrame([("b.py",)], "path string")).collect()
    assert [(r["path"], r["skeleton"]) for r in one] == [("b.py", got["b.py"])]


def test_a_contour_gathers_the_callers_of_its_symbols_only(spark):
    """all callers of all names were gathered and joined with every symbol for the lines of ten."""
    c = _code(spark, SHOWN)
    few = c.symbols.where("name = 'g' and kind = 'function'")
    got = xref.used_by(c, few, few=True)
    assert "LeftSemi, BuildRight" in _plan(got) and [r["used_by"] for r in got.collect()] == [["A.f (a.py:L2)", "h (b.py:L2)"]]
    assert "used_by: A.f (a.py:L2), h (b.py:L2)" in xref.contour(c, xref.ranked_symbols(few), "g").first()[0]
