"""Many questions in one plan against one question at a time."""

import os

import pytest

from lexquarry.engine import CorpusEngine
from lexquarry.operators.stored import StoredIndex
from lexquarry.plans.many import ask_many
from tests.test_engine import TREE, make

QUESTIONS = [
    "where is the readme file", "show only directories inside tests", "who uses IndexStore", "tests for rebuild_index", "where function rebuild_index", "где класс IndexStore", "find text about gamma", "find text about zebra",
    "список файлов в docs", "покажи все папки", "find guide in markdown", "list python files inside pkg", "кто использует helper", "where class nothing_here", "where method save", "tests for nothing_here", "show all files", " _?! ", "who uses helper inside pkg", "сервис",
]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    make(root, TREE)
    os.symlink(root / "README.md", root / "link.md")
    e = CorpusEngine.from_tree(spark, str(root))
    e.corpus.cache()
    return e


def test_many_questions(spark, engine, tmp_path):
    ix = StoredIndex.build(engine.corpus, str(tmp_path))
    rows = ask_many(ix, engine.corpus, spark.createDataFrame(list(enumerate(QUESTIONS)), "qid int, question string")).orderBy("qid", "rank").collect()
    got = {i: list(dict.fromkeys(r["path"] for r in rows if r["qid"] == i)) for i in range(len(QUESTIONS))}
    names = {i: [r["name"] for r in rows if r["qid"] == i] for i in range(len(QUESTIONS))}
    some = 0
    for i, q in enumerate(QUESTIONS):
        if not q.strip(" _?!"):
            assert got[i] == []
            continue
        want = engine.ask(q)
        assert got[i] == want["files"], (q, want["parsed_query"])
        if want["parsed_query"]["intent"] in ("find_symbol", "find_tests"):
            assert names[i] == [m["qualname"] for m in want["matches"]], q
        some += bool(want["files"])
    assert some > 10


def test_equal_questions_are_searched_once(spark, monkeypatch):
    """each of many equal questions was searched on its own."""
    from lexquarry.operators.stored import StoredIndex
    from lexquarry.plans.many import ask_many
    from lexquarry.queries import _documents

    c = _documents(spark, "/root/testdata/sf0.001")
    searched, each = [], StoredIndex.search_each
    monkeypatch.setattr(StoredIndex, "search_each", lambda ix, queries, *rest: searched.append(queries.count()) or each(ix, queries, *rest))
    asked = ["where is the doc file fr src3", "find text about nation", "where is the doc file fr src3"] * 3
    rows = ask_many(StoredIndex.build(c), c, spark.createDataFrame(list(enumerate(asked)), "qid int, question string")).collect()
    of = lambda i: sorted((r["path"], r["score"], r["rank"]) for r in rows if r["qid"] == i)
    assert searched == [2] and of(0) and all(of(i) == of(i % 3 % 2) for i in range(9))
