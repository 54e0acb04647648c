"""Reports from facts: equal to those of a whole index, before and after changes."""

from lexquarry import queries
from lexquarry.operators import report
from lexquarry.operators.corpus import Corpus, hold, stats
from lexquarry.sources.tables import from_documents
from lexquarry.streaming.refresh import classify

D = "/root/testdata/sf0.001"


def row(df):
    got = df.first().asDict()
    got["bm25_avg_document_length"] = round(got["bm25_avg_document_length"], 9)
    return got


def test_report_equals_the_whole_index_before_and_after_a_delta(spark):
    before, after, changes = queries._edited_with_words(spark, D)
    stored = hold(report.facts(before))
    want, want_after = row(stats(before, "corpus")), row(stats(after, "corpus"))
    assert row(report.report(stored, "corpus")) == want and len(want) == 27 and want != want_after
    new = hold(report.updated(stored, before, after, changes))
    assert row(report.report(new, "corpus")) == want_after
    rebuilt = report.facts(after)
    assert new.exceptAll(rebuilt).count() == 0 and rebuilt.exceptAll(new).count() == 0
    back = report.updated(new, after, before, changes)  # taken back again
    assert back.exceptAll(stored).count() == 0 and back.count() == stored.count()


def docs(spark, rows):
    c = Corpus(*from_documents(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")))
    return c, c.entries.select("path", "size_bytes").withColumnRenamed("size_bytes", "signature")


def test_last_holder_of_a_key_and_empty_corpora(spark):
    old, s0 = docs(spark, [(1, "a", "en", "alpha beta"), (2, "b", "fr", "beta gamma"), (3, "b", "fr", None), (4, "b", "fr", "")])
    new, s1 = docs(spark, [(1, "a", "en", "alpha beta")])
    none, s2 = docs(spark, [])
    got = hold(report.updated(hold(report.facts(old)), old, new, classify(s0, s1)))
    held = {(r["kind"], r["key"]): r["n"] for r in got.collect()}
    assert held["content_token", "beta"] == 1 and ("content_token", "gamma") not in held and ("path_token", "fr") not in held
    assert row(report.report(got, "r")) == row(stats(new, "r"))
    gone = report.updated(got, new, none, classify(s1, s2))
    assert row(report.report(gone, "r")) == row(stats(none, "r"))
    nothing = report.merged(report.facts(old), report.facts(old, -1))
    assert nothing.count() == 0 and report.report(nothing, "r").first()["token_count"] == 0


def test_only_changed_texts_are_tokenised(spark):
    old, s0 = docs(spark, [(i, "a", "en", f"word{i} common") for i in range(40)])
    new, s1 = docs(spark, [(i, "a", "en", f"word{i} common" + " more" * (i == 7)) for i in range(40)])
    changes = classify(s0, s1)
    assert [r["path"] for r in report.part(new, changes).texts.collect()] == ["a/en/doc_00000007.txt"]
    added = {(r["kind"], r["key"]): r["n"] for r in report.merged(report.facts(report.part(old, changes), -1), report.facts(report.part(new, changes))).collect()}
    assert added == {("content_token", "more"): 1, ("document", "a/en/doc_00000007.txt"): 1}
