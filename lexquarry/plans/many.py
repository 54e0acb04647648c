"""Many questions answered in one plan: each goes to the branch of its intent, each branch joins all its questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import terms
from ..operators import grams
from ..operators.corpus import Corpus, hold
from ..operators.search import by_score
from ..operators.stored import StoredIndex
from .ask import WORD, parse

_RESULT = ["qid", "intent", "path", "name", "line", "score", "rank"]


def _kept() -> list[Column]:
    """The order in which rows of a search are kept."""
    return [by_score(), F.lower("path").desc(), F.col("path").desc()]


def _top(df: DataFrame, order: list[Column], limit: Column, shown: list[Column] | None = None) -> DataFrame:
    """Each question's first `limit` rows in `order`, ranked in the order `shown`."""
    own = Window.partitionBy("qid")
    kept = df.withColumn("_n", F.row_number().over(own.orderBy(*order))).where(F.col("_n") <= limit)
    return kept.withColumn("rank", F.row_number().over(own.orderBy(*(shown or order)))).drop("_n")


def _inside(path: Column, prefix: Column) -> Column:
    """Whether a path passes a question's prefix, if it has one."""
    p = F.regexp_replace(prefix, "^/+|/+$", "")
    return prefix.isNull() | (prefix == "") | (path == p) | F.startswith(path, F.concat(p, F.lit("/")))


def _passes() -> Column:
    """Whether an entry passes the filters of a question in the same row."""
    suffix = F.lower("want_suffix")
    return (F.col("want_type").isNull() | (F.col("entry_type") == F.col("want_type"))) & (suffix.isNull() | (F.lower("suffix") == suffix)) & _inside(F.col("path"), F.col("path_prefix"))


def _files(ix: StoredIndex, c: Corpus, q: DataFrame) -> DataFrame:
    entries = c.entries.select("path", "name", "entry_type", "suffix")
    q = q.withColumnsRenamed({"entry_type": "want_type", "suffix": "want_suffix"}).withColumns({"q": F.lower(F.trim("query")), "cq": F.lower(F.trim("content_query"))})
    own = q.select("qid", "want_type", "want_suffix", "path_prefix", "limit", ((F.col("want_type") == "directory") & (F.col("q") == "") & (F.col("cq") == "")).alias("no_root"))
    has = lambda col: F.size(terms(F.col(col))) > 0
    ranked = q.where((has("q") | (F.col("q") == "")) & (has("cq") | (F.col("cq") == "")) & ((F.col("q") != "") | (F.col("cq") != "")))
    allowed = lambda docs: docs.join(entries, "path").join(own, "qid").where(_passes()).select("qid", "path", "score")
    # Questions that ask for the same are searched once, as the first of them; only its best rows go to the others.
    ranked = ranked.withColumn("first", F.min("qid").over(Window.partitionBy("q", "cq", "want_type", F.lower("want_suffix"), "path_prefix", "limit")))
    ranked = hold(ranked.select("first", "qid", "query", "content_query", F.greatest("limit", F.lit(10)).alias("most")))
    scored = ix.search_each(ranked.where("qid = first").select("qid", "query", "content_query"), 10, allowed).join(ranked.where("qid = first").select("qid", "most"), "qid")
    scored = _top(scored, _kept(), F.col("most")).select(F.col("qid").alias("first"), "path", "score").join(ranked.select("first", "qid"), "first").select("qid", "path", "score")
    # Questions without tokens: what names and paths hold of the query, by grams.
    keys = entries.select("path", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("path")))).alias("key"))
    odd = q.where((F.col("q") != "") & ~has("q") & (F.col("cq") == ""))
    within = grams.lookup(grams.index(keys), odd.select(F.col("q").alias("pattern"))).select(F.col("pattern").alias("q"), "path").distinct().join(odd.select("qid", "q"), "q").select("qid", "path", F.lit(0.0).alias("score"))
    # Questions with filters only: entries and filters meet on a type, a suffix and a folder, each of which may be any.
    bare = q.where("q = '' and cq = ''").select("qid", F.coalesce("want_type", F.lit("*")).alias("k1"), F.coalesce(F.lower("want_suffix"), F.lit("*")).alias("k2"), F.coalesce(F.regexp_replace("path_prefix", "^/+|/+$", ""), F.lit("*")).alias("k3"))
    steps = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    any_or = lambda col: F.explode(F.array_distinct(F.array(F.lit("*"), F.coalesce(col, F.lit("*")))))
    places = entries.select("path", any_or(F.col("entry_type")).alias("k1"), "suffix").select("path", "k1", any_or(F.lower("suffix")).alias("k2")).select("path", "k1", "k2", F.explode(F.concat(F.array(F.lit("*")), folders)).alias("k3"))
    first = Window.partitionBy("k1", "k2", "k3").orderBy(F.lower("path").desc(), F.col("path").desc())
    asked = places.join(bare.select("k1", "k2", "k3").distinct(), ["k1", "k2", "k3"], "left_semi").withColumn("n", F.row_number().over(first)).where("n <= 10").drop("n")
    listed = asked.join(bare, ["k1", "k2", "k3"]).select("qid", "path", F.lit(0.0).alias("score"))
    found = scored.unionByName(allowed(within)).unionByName(listed).join(own.select("qid", "limit", "no_root"), "qid")
    best = _top(found, _kept(), F.col("limit"), [by_score(), F.lower("path"), F.col("path")])
    return best.where("not (no_root and path = '.')").select("qid", F.lit("search_files").alias("intent"), "path", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("line"), "score", "rank")


def _usages(c: Corpus, q: DataFrame) -> DataFrame:
    own = q.select("qid", F.lower(F.trim("subject")).alias("name"), "path_prefix", "limit").where("name <> ''")
    hits = c.refs.select("name", "path", "cnt").join(own, "name").where(_inside(F.col("path"), F.col("path_prefix"))).join(c.entries.select("path", "walk_key"), "path", "left")
    best = _top(hits, [F.desc("cnt"), F.col("walk_key"), F.col("path")], F.greatest("limit", F.lit(1)))
    return best.select("qid", F.lit("find_usage").alias("intent"), "path", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("line"), F.col("cnt").cast("double").alias("score"), "rank")


def _named(symbols: DataFrame, subjects: DataFrame, key: Column) -> DataFrame:
    """(q, key) of the distinct lower-cased values of `key` that hold one of the subjects."""
    keys = symbols.select(F.lower(key).alias("key")).distinct()
    return grams.lookup(grams.index(keys), subjects.select(F.col("q").alias("pattern"))).withColumnRenamed("pattern", "q")


def _symbols(c: Corpus, q: DataFrame) -> DataFrame:
    own = q.select("qid", F.lower(F.trim("subject")).alias("q"), "symbol_kind", "path_prefix", "limit")
    subjects = own.select("q").where("q <> ''").distinct()
    s = c.symbols.select("path", "name", "qualname", "kind", "line", "ordinal").withColumns({"ln": F.lower("name"), "lq": F.lower("qualname")})
    exact = s.withColumn("q", F.explode(F.array_distinct(F.array("ln", "lq")))).join(subjects, "q")
    rest = subjects.join(exact.select("q").distinct(), "q", "left_anti")
    by_name = _named(s, rest, F.col("name")).join(s, F.col("key") == F.col("ln"))
    by_qual = _named(s, rest.where(F.length("q") >= 3), F.col("qualname")).join(s, F.col("key") == F.col("lq")).where(F.contains("ln", F.left("q", F.lit(3))))
    columns = ["q", "path", "name", "qualname", "kind", "line", "ordinal"]
    found = exact.select(columns).unionByName(by_name.select(columns)).unionByName(by_qual.select(columns)).distinct()
    last = found.groupBy("q", "path", "qualname", "line").agg(F.max_by(F.struct("name", "kind"), "ordinal").alias("s")).select("q", "path", "qualname", "line", "s.*")
    hits = last.join(own, "q").where(_inside(F.col("path"), F.col("path_prefix")))
    of_kind = hits.where(F.col("symbol_kind").isNull() | (F.col("kind") == F.col("symbol_kind")))
    hits = of_kind.unionByName(hits.join(of_kind.select("qid").distinct(), "qid", "left_anti"))
    best = _top(hits, [F.lower("path"), F.col("line"), F.lower("qualname")], F.col("limit"))
    return best.select("qid", F.lit("find_symbol").alias("intent"), "path", F.col("qualname").alias("name"), "line", F.lit(0.0).alias("score"), "rank")


def _tests(c: Corpus, q: DataFrame) -> DataFrame:
    own = q.select("qid", F.lower(F.trim("subject")).alias("q"), "path_prefix", "limit").where("q <> ''")
    subjects = own.select("q").distinct()
    tests = c.symbols.where("is_test").select("path", "name", "qualname", "line", "ordinal")
    at = lambda col: _named(tests, subjects, F.col(col)).join(tests, F.col("key") == F.lower(col)).select("q", "path", "ordinal", F.lit(1 if col == "path" else 0).alias("in_path"), F.lit(0 if col == "path" else 1).alias("in_name"), F.lit(0).cast("long").alias("cnt"))
    counts = c.refs.select(F.col("name").alias("q"), "path", "cnt").join(subjects, "q").groupBy("q", "path").agg(F.sum("cnt").alias("cnt"))
    by_ref = counts.join(tests.select("path", "ordinal"), "path").select("q", "path", "ordinal", F.lit(0).alias("in_path"), F.lit(0).alias("in_name"), "cnt")
    marks = at("name").unionByName(at("qualname")).unionByName(at("path")).unionByName(by_ref)
    score = 4 * F.max("in_name") + 3 * F.max("cnt") + 2 * F.max("in_path")
    hits = marks.groupBy("q", "path", "ordinal").agg(score.cast("double").alias("score")).where("score > 0").join(tests, ["path", "ordinal"]).join(own, "q").where(_inside(F.col("path"), F.col("path_prefix")))
    best = _top(hits, [F.desc("score"), F.lower("path"), F.col("line"), F.col("ordinal")], F.col("limit"))
    return best.select("qid", F.lit("find_tests").alias("intent"), "path", F.col("qualname").alias("name"), "line", "score", "rank")


def ask_many(ix: StoredIndex, c: Corpus, questions: DataFrame) -> DataFrame:
    """(qid, intent, path, name, line, score, rank): the matches of each question (qid: int, question) in the order that plans.ask.ask shows them.

    Questions without a word have no rows. No question is looked at on the driver; each branch takes all questions of its intents, and their
    matches are found by joins on tokens, grams, names or folders.
    """
    q = hold(parse(questions, c.entries).where(F.col("question").rlike(WORD)))
    of = lambda intent: q.where(F.col("intent") == intent)
    return _files(ix, c, of("search_files")).unionByName(_usages(c, of("find_usage"))).unionByName(_symbols(c, of("find_symbol"))).unionByName(_tests(c, of("find_tests"))).select(_RESULT)
