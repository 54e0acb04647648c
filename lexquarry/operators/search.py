"""Ranked search over names, paths and contents."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.excerpts import proximity_boost
from ..functions.tokens import lines, query_terms, under
from .corpus import K1, Corpus, beside, hold, idf, norm
from .counts import counted, each_term


#: Scores that differ by less may be ties: sums of the same gains in another order.
SAME = 1e-9


def by_score(places: int = 9) -> Column:
    """Best first; scores that agree in nine places are ties, whatever order their gains were added in. Fewer places are for results that show no more."""
    return F.round("score", places).desc()


def suffix_filter(suffix: str) -> Column:
    """Whatever the case, with or without dot."""
    s = suffix.lower()
    return F.lower("suffix") == (s if s.startswith(".") else "." + s)


def prefix_filter(prefix: str) -> Column:
    """An entry or what is below it; `.` is the root entry only."""
    return under(F.col("path"), "." if prefix == "." else prefix.strip("/"))


def candidates(c: Corpus, query: str = "", content_query: str = "", entry_type: str | None = None, suffix: str | None = None, path_prefix: str | None = None, found: DataFrame | None = None) -> DataFrame:
    """Entries with any token of the query in name or path, and any of the content query in the body, that pass all filters. `found` are the rows of matches() for the content query's tokens."""
    out = c.entries
    for condition in (F.col("entry_type") == entry_type if entry_type else None, suffix_filter(suffix) if suffix else None, prefix_filter(path_prefix) if path_prefix else None):
        if condition is not None:
            out = out.where(condition)
    q = query.strip().lower()
    if q:
        tokens = sorted(set(query_terms(q)))
        if tokens:
            out = out.join(c.path_tokens.where(F.col("token").isin(tokens)).select("path"), "path", "left_semi")
        else:
            out = out.where(F.contains(F.lower("name"), F.lit(q)) | F.contains(F.lower("path"), F.lit(q)))
    cq = content_query.strip().lower()
    if cq:
        tokens = sorted(set(query_terms(cq)))
        held = c.content_tokens if found is None else each_term(found, "path").where("in_body > 0").withColumnRenamed("term", "token")
        out = out.join(held.where(F.col("token").isin(tokens)).select("path"), "path", "left_semi") if tokens else out.where(F.lit(False))
    return out


def bm25_terms(query: str, content_query: str) -> list[str]:
    """The scored terms, repeats included: of the query, then of the content query, both lower-cased first."""
    return query_terms(query.strip().lower()) + query_terms(content_query.strip().lower())


#: Up to so many distinct terms are literals of the plan, beyond a broadcast table of the queries' terms.
LITERALS = 500


def matches(c: Corpus, names: list[str]) -> DataFrame | None:
    """What the documents hold of some terms, with their lengths (rows of counts.counted), from one pass over the texts; None where postings are held."""
    return None if c.has_postings else hold(counted(c, sorted(set(names))))


def scores(c: Corpus, qterms: list[tuple[int, str, int]], found: DataFrame | None = None) -> DataFrame:
    """(qid, path, score) of every document that has a term of a query; qterms are (qid, term, repeats), `found` the matches() of their terms.

    Texts are read once, and only terms of the queries leave the tasks that count them. Of held postings only those of the queries' terms are read.
    """
    asked = c.spark.createDataFrame(qterms, "qid int, term string, qtf int")
    names = sorted({t for _, t, _ in qterms})
    found = matches(c, names) if found is None else found
    if found is not None:
        some = each_term(found, "path", "dl").where("tf > 0")
        stats = found.where("dl > 0").agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
        some = beside(some, stats).withColumn("norm", norm(F.col("dl"), F.col("avgdl"))).drop("dl", "avgdl", "n")
        rows = some
    else:
        some = c.doc_terms.where(F.col("term").isin(names)) if len(names) <= LITERALS else c.doc_terms.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
        stats = c.corpus_stats
        rows = some.join(c.doc_stats.select("path", "norm"), "path")
    df = some.groupBy("term").agg(F.count("*").alias("df"))
    wanted = F.broadcast(df.join(F.broadcast(asked), "term"))  # as many rows as the queries have terms
    hits = beside(rows.join(wanted, "term"), stats)
    gain = F.col("qtf") * idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + F.col("norm"))
    return hits.groupBy("qid", "path").agg(F.sum(gain).alias("score"))


def top(scored: DataFrame, limit: int, places: int = 9) -> DataFrame:
    """The best `limit` rows. At the cut, ties go to the lexicographically larger lower-cased paths; the result is then in ascending order."""
    if limit <= 0:
        return scored.limit(0)
    cut = scored.orderBy(by_score(places), F.lower("path").desc(), F.col("path").desc()).limit(limit)
    return cut.orderBy(by_score(places), F.lower("path"), "path")


def search(c: Corpus, query: str = "", content_query: str = "", entry_type: str | None = None, suffix: str | None = None, path_prefix: str | None = None, limit: int = 50, proximity: bool = False, places: int = 9) -> DataFrame:
    """Entries with `score`, best first; scores that agree in so many places are ties."""
    terms = bm25_terms(query, content_query)
    held = matches(c, terms) if terms else None
    found = candidates(c, query, content_query, entry_type, suffix, path_prefix, held)
    if not terms:
        return top(found.withColumn("score", F.lit(0.0)), limit, places)
    qterms = [(0, t, n) for t, n in Counter(terms).items()]
    scored = found.join(scores(c, qterms, held).drop("qid"), "path", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    if proximity:
        ranked = scored.join(c.bodies.select("path", "text"), "path", "left")
        boost = proximity_boost(F.when(F.col("text").isNotNull(), lines(F.col("text"))), F.array(*[F.lit(t) for t in terms]))
        scored = ranked.withColumn("score", F.col("score") + boost).drop("text")
    return top(scored, limit, places)


def search_many(c: Corpus, queries: list[str], limit: int = 5) -> DataFrame:
    """(qid, query, path, score, rank) for many queries in one plan: each one's candidates by name or path tokens, ranked as search() does."""
    rows = [(i, q, t, n) for i, q in enumerate(queries) for t, n in Counter(bm25_terms(q, "")).items()]
    qterms = c.spark.createDataFrame(rows, "qid int, query string, term string, qtf int")
    found = c.path_tokens.withColumnRenamed("token", "term").join(F.broadcast(qterms.select("qid", "query", "term")), "term").select("qid", "query", "path").distinct()
    scored = found.join(scores(c, [(i, t, n) for i, _, t, n in rows]), ["qid", "path"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    cut = Window.partitionBy("qid").orderBy(by_score(), F.lower("path").desc(), F.col("path").desc())
    shown = Window.partitionBy("qid").orderBy(by_score(), F.lower("path"), "path")
    kept = scored.withColumn("cut", F.row_number().over(cut)).where(F.col("cut") <= limit)
    return kept.withColumn("rank", F.row_number().over(shown)).drop("cut")
