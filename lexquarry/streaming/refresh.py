"""Incremental refresh: classified changes, tables carried over, and generations published atomically."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import Corpus, hold
from ..operators.extract import extract_all
from ..operators.stored import StoredIndex
from ..sources.fstree import IGNORED_NAMES, complete, read_texts, register, scan
from .folder import Folder

TABLES = ("entries", "texts", "symbols", "refs")
#: Seconds after which a rebuild that never ended counts as lost.
LEASE = 86_400


def classify(old: DataFrame, new: DataFrame, signature: str = "signature") -> DataFrame:
    """(path, change) of two snapshots: added, removed or modified, by path and change signature; unchanged paths have no row."""
    both = old.select("path", F.col(signature).alias("s0"), F.lit(True).alias("in0")).join(new.select("path", F.col(signature).alias("s1"), F.lit(True).alias("in1")), "path", "full_outer")
    change = F.when(F.col("in0").isNull(), "added").when(F.col("in1").isNull(), "removed").when(~F.col("s0").eqNullSafe(F.col("s1")), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def apply_delta(old: DataFrame, fresh: DataFrame, changes: DataFrame) -> DataFrame:
    """A table's rows of unchanged paths, and the fresh rows of added and modified ones."""
    return old.join(changes.select("path"), "path", "left_anti").unionByName(fresh)


def counts(changes: DataFrame) -> dict[str, int]:
    got = {r[0]: r[1] for r in changes.groupBy("change").count().collect()}
    return {k: got.get(k, 0) for k in ("added", "modified", "removed")}


def build(spark: SparkSession, root: str, ignore: tuple[str, ...] = IGNORED_NAMES) -> Corpus:
    """All tables of a tree from scratch, as the tree is now: later changes of its files don't show in them."""
    entries = hold(scan(spark, root, ignore))
    texts = hold(read_texts(entries.where("entry_type = 'file'"), root))
    symbols, refs = extract_all(texts)
    return Corpus(entries, texts, symbols, refs)


def refreshed(old: Corpus, entries: DataFrame, root: str, keep: bool = True) -> tuple[Corpus, dict[str, int], Corpus | None, DataFrame]:
    """The corpus of the new entries, of which only changed files are read, parsed and tokenised again; equal to a build from scratch. Then what
    changed: counts, the changed rows alone, and the changes (path, change).
    Without changes it is the old corpus, and nothing is written. With `keep` its tables are held; else the caller saves them."""
    seen = entries.cache()
    changes = hold(classify(old.entries, seen))
    n = counts(changes)
    if not any(n.values()):
        seen.unpersist()
        return old, n, None, changes
    settle = hold if keep else lambda df: df
    entries = hold(seen)
    seen.unpersist()
    touched = changes.where("change <> 'removed'").select("path")
    own = entries.join(touched, "path", "left_semi")
    texts = hold(read_texts(own.where("entry_type = 'file'"), root))
    symbols, refs = extract_all(texts)
    fresh = Corpus(own, texts, symbols, refs)
    parts = (settle(apply_delta(getattr(old, k), getattr(fresh, k), changes)) for k in TABLES[1:])
    new = Corpus(entries, *parts)
    if keep and "postings" in old.tables:
        new.tables["postings"] = hold(apply_delta(old.postings, fresh.postings, changes))
    return new, n, fresh, changes


class Generations:
    """Corpora saved with their index as numbered Parquet folders outside the scanned root, on any Hadoop file system.

    A rebuild takes a number when it starts (a file in `started`, removed when it ends) and is published by the next file in
    `commits`, which only one writer can create: if others were faster, it looks again, and is dropped where one that started later
    was published. The last `kept` generations stay, with the segments of their index; older ones are removed.
    """

    def __init__(self, spark: SparkSession, home: str, kept: int = 3) -> None:
        self.spark, self.home, self.kept = spark, home.rstrip("/"), kept
        self._started, self._commits = Folder(spark, f"{self.home}/started"), Folder(spark, f"{self.home}/commits")
        self._tables, self._segments = Folder(spark, f"{self.home}/tables"), Folder(spark, f"{self.home}/index")

    def commits(self) -> list[tuple[int, dict]]:
        """Published commits in their order: numbers and manifests."""
        return [(int(x), json.loads(self._commits.read(x))) for x in self._commits.names() if x.isdigit()]

    def _last(self) -> tuple[int, dict]:
        names = [x for x in self._commits.names() if x.isdigit()]
        return (int(names[-1]), json.loads(self._commits.read(names[-1]))) if names else (0, {"generation": 0})

    @property
    def current(self) -> int:
        return self._last()[1]["generation"]

    def start(self) -> int:
        """A number larger than that of any rebuild started before that still runs or was published."""
        while True:
            n = 1 + max([self.current, *(int(x) for x in self._started.names() if x.isdigit())])
            if self._started.put(f"{n:012d}", str(time.time())):
                return n

    def end(self, n: int) -> None:
        self._started.remove(f"{n:012d}")

    def publish(self, c: Corpus, n: int, index: StoredIndex | None = None) -> bool:
        """Saves the corpus and its index (built here, if not given) as generation n; False if a later one is current already."""
        at = f"{self.home}/tables/{n}"
        for k in TABLES:
            getattr(c, k).write.mode("overwrite").parquet(f"{at}/{k}")
        index = index or StoredIndex.build(self._read(n), f"{self.home}/index", positions=True)
        manifest = {"generation": n, "index": {"segments": [s.rsplit("/", 1)[1] for s in index.segments], "buckets": index.buckets, "parts": index.parts, "documents": index.documents, "changed": index.changed, "positions": index.positions}}
        while True:
            last, now = self._last()
            if now["generation"] >= n:
                if now["generation"] > n:
                    self._tables.remove(str(n))
                    for s in set(manifest["index"]["segments"]) - {s for _, m in self.commits() for s in m["index"]["segments"]}:
                        self._segments.remove(s)
                return False
            if self._commits.put(f"{last + 1:012d}", json.dumps(manifest)):
                self._clean(n)
                return True

    def _clean(self, n: int) -> None:
        """Removes generations before the last ones and segments that only they use, unless another rebuild runs, which may read them."""
        for x in self._started.names():
            if x.isdigit() and int(x) != n:
                if time.time() - float(self._started.read(x) or 0) < LEASE:
                    return
                self._started.remove(x)
        commits = self.commits()
        live = [m for _, m in commits[-self.kept :]]
        for name in set(self._segments.names()) - {s for m in live for s in m["index"]["segments"]}:
            self._segments.remove(name)
        for name in set(self._tables.names()) - {str(m["generation"]) for m in live}:
            self._tables.remove(name)
        for number, _ in commits[: -self.kept]:
            self._commits.remove(f"{number:012d}")

    def _read(self, n: int) -> Corpus:
        return Corpus(*(self.spark.read.parquet(f"{self.home}/tables/{n}/{k}") for k in TABLES))

    def _manifest(self, n: int | None) -> dict:
        found = {m["generation"]: m for _, m in self.commits()}
        n = max(found, default=0) if n is None else n
        if n not in found:
            raise FileNotFoundError(f"{self.home}: generation {n}")
        return found[n]

    def index(self, n: int | None = None) -> StoredIndex:
        """The stored index of a generation, the current one if none is named."""
        m = self._manifest(n)["index"]
        return StoredIndex(self.spark, [f"{self.home}/index/{s}" for s in m["segments"]], m["buckets"], m["parts"], m["documents"], m["changed"], m["positions"])

    def load(self, n: int | None = None) -> Corpus:
        """A saved corpus. Its postings and statistics are those of its index: no text is tokenised again."""
        m = self._manifest(n)
        c, ix = self._read(m["generation"]), self.index(m["generation"])
        rows = ix.postings()
        c.tables |= {
            "postings": rows.where("tf > 0 or in_body > 0").select("path", "term", "tf", "in_body"), "path_tokens": rows.where("in_path").select("path", F.col("term").alias("token")), "term_stats": ix.terms(),
            "corpus_stats": ix.totals().select(F.coalesce("n", F.lit(0)).alias("n"), "avgdl"), "doc_lengths": rows.where("tf > 0").select("path", "dl").distinct(),
        }
        c.held = True
        return c

    def refresh(self, root: str, entries: DataFrame | None = None, ignore: tuple[str, ...] = IGNORED_NAMES) -> dict:
        """Publishes what changed since the current generation: {"mode", "added", "modified", "removed"}. A root that is gone gives an empty generation."""
        n = self.start()
        try:
            gone = not os.path.exists(root)
            if entries is None and not gone:
                entries = scan(self.spark, root, ignore)
            if not self.current:
                if not gone:
                    self.publish(build(self.spark, root, ignore), n)
                return {"mode": "full", "added": 0 if gone else entries.count(), "modified": 0, "removed": 0}
            old = self._read(self.current)
            if gone:
                self.publish(Corpus(old.entries.limit(0), old.texts.limit(0), old.symbols.limit(0), old.refs.limit(0)), n)
                return {"mode": "incremental", "added": 0, "modified": 0, "removed": old.entries.count()}
            index = self.index()
            new, delta, fresh, changes = refreshed(old, entries, root, keep=False)
            if fresh is not None:
                self.publish(new, n, index.updated(old, fresh, changes, f"{self.home}/index"))
            return {"mode": "incremental", **delta}
        finally:
            self.end(n)


def follow(spark: SparkSession, root: str, home: str, every: str | None = "2 seconds", on_batch: Callable[[dict], None] | None = None, checkpoint: str | None = None):
    """A streaming query that refreshes the generations under `home` from snapshots of the tree; once, if `every` is None."""
    register(spark)
    store = Generations(spark, home)

    def batch(df: DataFrame, _: int) -> None:
        delta = store.refresh(root, complete(df))
        if on_batch:
            on_batch(delta)

    stream = spark.readStream.format("fstree").option("path", root).option("ignore", ",".join(IGNORED_NAMES)).load().writeStream.foreachBatch(batch)
    stream = stream.option("checkpointLocation", checkpoint or os.path.join(home, "stream"))
    return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()
