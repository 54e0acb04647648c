"""gains that were added in another order don't part documents of equal scores."""

from pyspark.sql import functions as F

from lexquarry.operators import search
from lexquarry.operators.corpus import Corpus
from lexquarry.operators.stored import StoredIndex
from lexquarry.sources.tables import from_documents

ONE = 0.1 + 0.2 + 0.7  # and the same gains the other way round
OTHER = 0.7 + 0.2 + 0.1


def test_top_takes_equal_scores_as_ties(spark):
    assert ONE != OTHER
    rows = spark.createDataFrame([("a", max(ONE, OTHER)), ("b", min(ONE, OTHER)), ("c", 0.5)], "path string, score double")
    assert [r["path"] for r in search.top(rows, 1).collect()] == ["b"]
    assert [r["path"] for r in search.top(rows.replace({"a": "z"}), 2).collect()] == ["b", "z"]


def test_a_stored_index_takes_equal_scores_as_ties(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, "s", "en", "alpha beta gamma") for i in range(4)], "doc_id long, source string, lang string, text string")
    ix = StoredIndex.build(Corpus(*from_documents(docs)), str(tmp_path))
    whole = StoredIndex._scores
    less = F.when(F.col("path") == "s/en/doc_00000003.txt", F.col("score") * (1 - 2.3e-16)).otherwise(F.col("score"))
    monkeypatch.setattr(StoredIndex, "_scores", lambda *a: whole(*a).withColumn("score", less))
    got = [(r["path"], r["rank"]) for r in ix.search_many([("", "alpha beta")], 2).collect()]
    assert sorted(got, key=lambda x: x[1]) == [("s/en/doc_00000002.txt", 1), ("s/en/doc_00000003.txt", 2)]
