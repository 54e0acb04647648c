"""The driver's contract: names, and the engine's queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from lexquarry import queries as own

D = "/root/testdata/sf0.001"
FAST = ["entries_scan", "pages_scan", "fs_totals", "children_count", "tokenize_terms", "highlight", "doc_terms", "excerpt_clusters", "bm25_symbol_weights", "tree_files", "tree_stats", "tree_texts", "file_skeleton", "contour", "ask_parse", "path_postings", "corpus_stats", "search_path", "topk_tie_cut", "line_scores", "py_symbols", "py_refs", "c_symbols", "usages_rank", "used_by", "delta_classify", "delta_apply", "scip_defs", "scip_refs", "symbol_search_exact", "symbol_search_trigram", "related_tests", "resolve_ref", "subtree_totals", "line_scores_by_positions", "search_stored_index"]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(own.queries()) <= set(entry.queries())


def test_entry_without_the_corpus_operators(monkeypatch):
    """If they can't be imported, whatever the reason, the other queries stay."""
    import sys

    for gone in ("lexquarry.llm.queries", "corpus_pipeline"):
        with monkeypatch.context() as m:
            m.setitem(sys.modules, gone, None)
            assert set(own.queries()) <= set(entry.queries())
            assert "pipeline" not in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as from '{D}/{t}.parquet'")
    got = own.queries()[name](spark, D).toArrow()
    want = con.sql(own.oracle_sql()[name])
    cols = sorted(got.column_names)
    assert cols == sorted(want.columns)
    rows = lambda t: sorted(map(repr, zip(*[t[c] for c in cols], strict=True)))
    data = want.fetchall()
    assert rows(got.to_pydict()) == rows({c: [r[want.columns.index(c)] for r in data] for c in cols})
