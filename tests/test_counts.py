"""Documents counted as a whole: one pass over the texts gives what searches and reports need."""

import pytest

from lexquarry.operators import report, search
from lexquarry.operators.counts import counted, each_term
from lexquarry.operators.corpus import Corpus
from lexquarry.queries import _with_symbols, _with_words
from lexquarry.sources.tables import from_documents

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    return lambda: Corpus(*from_documents(spark.read.parquet(f"{D}/documents.parquet")))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_search_counts_its_texts_once(spark, corpus):
    """What is scored are the rows of one pass, of the asked terms only."""
    scored = plan(search.scores(corpus(), [(0, "the", 1), (0, "src3", 2)]))
    assert "MapInArrow" not in scored and "split(" not in scored
    found = counted(corpus(), ["the", "src3", "zzzz"])
    assert {r["term"] for r in each_term(found, "path").select("term").distinct().collect()} == {"the", "src3"}


def test_held_and_counted_postings_give_the_same(spark, corpus):
    fresh, held = corpus(), corpus().cache()
    try:
        rows = lambda c: [(r["path"], round(r["score"], 9)) for r in search.search(c, "src3 doc", content_query="the nation", limit=40).collect()]
        assert rows(fresh) == rows(held) and len(rows(fresh)) > 0
        for name in ("doc_lengths", "corpus_stats", "term_stats"):
            a, b = getattr(fresh, name), getattr(held, name)
            assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    finally:
        held.unpersist()


def test_symbols_count_and_figures_of_a_document_agree_with_its_terms(spark, corpus):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for r in counted(_with_symbols(spark, D)).collect():
        assert r["dl"] == sum(r["tfs"]) and r["most"] == max(r["tfs"], default=0) and r["n_terms"] == sum(x > 0 for x in r["tfs"]) and len(r["terms"]) == len(set(r["terms"]))
    assert docs.count() <= counted(corpus()).count()


def test_facts_come_from_whole_documents(spark, corpus):
    """no row a posting is made for the facts of documents, and first words don't split whole texts."""
    c = _with_words(corpus())
    assert "regexp_extract" in plan(c.symbols) and "split(" not in plan(c.symbols)
    facts = {(r["kind"], r["key"]): (r["n"], r["size"]) for r in report.facts(c).where("kind = 'document'").collect()}
    lengths = {r["path"]: r["dl"] for r in c.doc_lengths.collect()}
    assert {k: v for (_, k), (_, v) in facts.items()} == lengths
