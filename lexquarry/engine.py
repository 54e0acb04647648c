"""The public face of the engine: one object per corpus, results as DataFrames or plain values."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.excerpts import excerpt, symbol_excerpt
from .functions.tokens import normalize_path, query_terms
from .operators import corpus as tables
from .operators import search as searching
from .operators import xref
from .plans import ask as asking
from .sources.fstree import IGNORED_NAMES, resolve_requested, scan
from .streaming.refresh import Generations, build, refreshed


def clean_path(path: str | None) -> str:
    """Trimmed, without one leading `./` and outer slashes; blank is the root. ValueError for None."""
    if path is None:
        raise ValueError("path is required")
    return path.strip().removeprefix("./").strip("/") or "."


class CorpusEngine:
    """Queries over one corpus; rebuild() and refresh() replace it as a whole."""

    def __init__(self, spark: SparkSession, corpus: tables.Corpus, root: str = ".") -> None:
        self.spark, self.corpus, self.root = spark, corpus, root
        self.last_built_at, self.cached = time.time(), False

    @classmethod
    def from_tree(cls, spark: SparkSession, root: str) -> CorpusEngine:
        return cls(spark, build(spark, root), root)

    @classmethod
    def from_generation(cls, spark: SparkSession, home: str, root: str = ".") -> CorpusEngine:
        return cls(spark, Generations(spark, home).load(), root)

    def cache(self) -> CorpusEngine:
        """Holds the index in memory, now and after every rebuild or refresh."""
        self.cached = True
        self.corpus.cache()
        return self

    def rebuild(self) -> DataFrame:
        old, self.corpus = self.corpus, build(self.spark, self.root)
        if self.cached:
            self.corpus.cache()
            old.unpersist()
        self.last_built_at = time.time()
        return self.index_stats()

    def refresh(self) -> dict[str, int]:
        """Takes over what changed in the tree: counts of added, modified and removed entries."""
        new, delta, _, _ = refreshed(self.corpus, scan(self.spark, self.root, IGNORED_NAMES), self.root)
        if new is not self.corpus and self.cached:
            new.cache()
            self.corpus.unpersist()
        self.corpus = new
        self.last_built_at = time.time()
        return {"mode": "incremental", **delta}

    def index_stats(self) -> DataFrame:
        return tables.stats(self.corpus, self.root, True, self.last_built_at)

    def health(self) -> dict:
        return {"status": "ok", "root": self.root, "index": self.index_stats().first().asDict()}

    def scan(self, path: str = ".", ignore: tuple[str, ...] | None = None) -> DataFrame:
        """A live listing below the root; nothing is ignored unless asked for."""
        return scan(self.spark, resolve_requested(self.root, path), ignore)

    def entry(self, path: str) -> DataFrame:
        """One row with `content_indexed`; FileNotFoundError without such an entry."""
        p = clean_path(path)
        row = self.corpus.entries.where(F.col("path") == p).join(self.corpus.bodies.select("path", F.lit(True).alias("content_indexed")), "path", "left")
        if not row.limit(1).count():
            raise FileNotFoundError(p)
        return row.withColumn("content_indexed", F.coalesce("content_indexed", F.lit(False)))

    def children(self, path: str = ".") -> DataFrame:
        """Entries of a directory; ValueError for anything else."""
        if self.entry(path).first()["entry_type"] != "directory":
            raise ValueError(f"not a directory: {path}")
        return tables.children(self.corpus.entries, clean_path(path))

    def search(self, query: str = "", **filters) -> DataFrame:
        return searching.search(self.corpus, query, **filters)

    def search_many(self, queries: list[str], limit: int = 5) -> DataFrame:
        return searching.search_many(self.corpus, queries, limit)

    def excerpt(self, path: str, query: str) -> str | None:
        terms = F.array(*[F.lit(t) for t in query_terms(query)]).cast("array<string>")
        row = self.corpus.bodies.where(F.col("path") == path).select(excerpt(F.col("path"), F.col("text"), terms)).first()
        return row[0] if row else None

    def symbols(self, name: str = "", kind: str | None = None, path_prefix: str | None = None, limit: int = 20) -> DataFrame:
        found = xref.search_symbols(self.corpus, name, kind, path_prefix, limit)
        terms = F.array(*[F.lit(t) for t in query_terms(name)]).cast("array<string>")
        out = found.join(self.corpus.texts, "path", "left").withColumn("excerpt", symbol_excerpt(F.col("text"), F.col("line"), F.col("end_line"), terms)).drop("text")
        return out.orderBy(F.lower("path"), "line", F.lower("qualname"))

    def usages(self, name: str, path_prefix: str | None = None, limit: int = 20) -> DataFrame:
        return xref.usages(self.corpus, name, path_prefix, limit)

    def related_tests(self, name: str, path_prefix: str | None = None, limit: int = 20) -> DataFrame:
        return xref.related_tests(self.corpus, name, path_prefix, limit)

    def skeleton(self, path: str) -> str:
        p = self.spark.createDataFrame([(path,)], "path string").select(normalize_path(F.col("path")).alias("path"))
        return xref.file_skeletons(self.corpus, p).first()["skeleton"]

    def contour(self, query: str, limit: int = 10) -> str:
        return xref.contour(self.corpus, xref.ranked_symbols(xref.search_symbols(self.corpus, query, limit=limit)), query).first()[0]

    def ask(self, question: str) -> dict:
        return asking.ask(self.corpus, question)


def main(argv: list[str] | None = None) -> None:
    """Answers one request over a directory tree as JSON."""
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("--root", required=True)
    p.add_argument("command", choices=["stats", "search", "ask", "symbols", "usages", "tests", "skeleton", "contour", "children"])
    p.add_argument("argument", nargs="?", default="")
    p.add_argument("--limit", type=int, default=20)
    a = p.parse_args(argv)
    e = CorpusEngine.from_tree(SparkSession.builder.appName("lexquarry").getOrCreate(), a.root)
    calls = {
        "stats": lambda: e.index_stats(), "search": lambda: e.search(a.argument, limit=a.limit), "ask": lambda: e.ask(a.argument), "symbols": lambda: e.symbols(a.argument, limit=a.limit),
        "usages": lambda: e.usages(a.argument, limit=a.limit), "tests": lambda: e.related_tests(a.argument, limit=a.limit), "skeleton": lambda: e.skeleton(a.argument),
        "contour": lambda: e.contour(a.argument, a.limit), "children": lambda: e.children(a.argument or "."),
    }
    out = calls[a.command]()
    if isinstance(out, DataFrame):
        out = [r.asDict(recursive=True) for r in out.collect()]
    print(json.dumps(out, ensure_ascii=False, default=str))


if __name__ == "__main__":
    main()
