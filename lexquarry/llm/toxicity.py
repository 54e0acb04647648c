"""Toxicity from the nearest labelled examples by exact TF-IDF cosine, found with a block-max inverted index.

The index holds a bounded sample of labelled documents. Its terms are all words and word beginnings of the sample that its
positive documents hold significantly more often (LEAST_CHI; 0 keeps every term). Postings are kept by term in blocks of
examples, with the largest weight of every term in every block: a block whose bound stays below the k-th best cosine so far
cannot hold a neighbour and is never read. Neighbours vote in proportion to their cosine, against the base rate of labels;
what share of the examples with such a vote is positive, each judged by the others, gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import slices
from ._words import PLAIN, Words

#: The bounded sample: examples of either label, characters of an example; longer documents are not drawn.
POSITIVE, NEGATIVE, EXAMPLE_CHARS = 1000, 2000, 20_000
#: The least chi-squared of a term of the index.
LEAST_CHI = 20.0
#: Examples in a block of postings; neighbours that vote; weight of the base rate beside their cosines.
BLOCK, NEIGHBOURS, SMOOTHING = 64, 15, 2.0
PREFIXES = (4, 5)
EXAMPLE_BATCH = 1 << 19


def _pairs(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Document number and term hash of every term occurrence."""
    doc = w.doc_of_word()
    docs, terms = [doc], [w.hash]
    for k in PREFIXES:
        at, h = w.prefixes(k)
        docs.append(doc[at])
        terms.append(h)
    return np.concatenate(docs), np.concatenate(terms)


class Model:
    """Selected terms, their document frequencies and the block-max index of the examples."""

    def __init__(self, ids: list[int], example_texts: list[str], labels: list[int], base_rate: float, least_chi: float = LEAST_CHI) -> None:
        self.ids, self.label, self.base_rate = np.array(ids, dtype=np.int64), np.array(labels, dtype=np.float64), base_rate
        self.texts, self.read = example_texts, 0
        found, held = [], []  # each batch's terms, and how many of its examples of either label hold them
        for lo, w in self._batches():
            d, t = _pairs(w)
            u, t = np.unique(t, return_inverse=True)
            seen = np.unique(d * max(1, len(u)) + t)
            y = self.label[lo + seen // max(1, len(u))]
            a = np.bincount(seen % max(1, len(u)), weights=y, minlength=len(u))
            found.append(u)
            held.append(np.stack([a, np.bincount(seen % max(1, len(u)), minlength=len(u)) - a]))
        terms, at = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_inverse=True)
        both = np.concatenate(held, axis=1) if held else np.empty((2, 0))
        a, c = (np.bincount(at, weights=x, minlength=len(terms)) for x in both)
        p, q = self.label.sum(), len(ids) - self.label.sum()
        n = p + q
        off = a * (q - c) - (p - a) * c
        chi = np.where(off > n / 2, n * (off - n / 2) ** 2 / np.maximum(p * q * (a + c) * (n - a - c), 1e-9), 0.0)
        self.terms = terms[chi > least_chi] if least_chi else terms

    def _batches(self) -> Iterator[tuple[int, Words]]:
        """The examples' words, a bounded number of characters at once."""
        lo = size = 0
        for hi, t in enumerate([*self.texts, None]):
            if hi > lo and (t is None or size + len(t) > EXAMPLE_BATCH):
                yield lo, Words(self.texts[lo:hi], PLAIN, True)
                lo, size = hi, 0
            size += len(t or "")

    def counts(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, term number and occurrences of the index's terms, by document."""
        d, h = _pairs(w)
        n = len(self.terms)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.searchsorted(self.terms, h)
        at[at == n] = 0
        ok = self.terms[at] == h
        key, count = np.unique(d[ok] * n + at[ok], return_counts=True)
        return key // n, key % n, count

    def weights(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """TF-IDF weights of unit length: document, term number, weight."""
        d, t, c = self.counts(w)
        x = (1 + np.log(np.maximum(c, 1))) * self.idf[t] if len(d) else np.empty(0)
        norm = np.sqrt(np.bincount(d, weights=x * x, minlength=len(w)))
        return d, t, x / norm[d] if len(d) else x

    def index(self, frequency: dict[int, int], documents: int) -> Model:
        """Builds the postings, with idf from the whole corpus."""
        df = np.array([frequency.get(i, 0) for i in range(len(self.terms))], dtype=np.float64)
        self.idf = np.log((documents + 1) / (df + 1)) + 1
        parts = [(d + lo, t, x) for lo, w in self._batches() for d, t, x in [self.weights(w)]]
        d, t, x = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        self.blocks = -(-len(self.ids) // BLOCK)
        order = np.lexsort((d, t))
        self.example, self.weight = d[order], x[order]
        key, first = np.unique(t[order] * self.blocks + self.example // BLOCK, return_index=True)  # terms' blocks that hold a posting
        self.posting = np.append(first, len(order))
        self.block = key % max(1, self.blocks)
        self.top = np.maximum.reduceat(self.weight, first) if len(first) else np.empty(0)
        self.lead = np.searchsorted(key, np.arange(len(self.terms) + 1) * self.blocks)
        del self.texts
        self._calibrate(d, t, x)
        return self

    def _vote(self, e: np.ndarray, s: np.ndarray) -> float:
        return (s @ self.label[e] + SMOOTHING * self.base_rate) / (s.sum() + SMOOTHING)

    def _calibrate(self, d: np.ndarray, t: np.ndarray, x: np.ndarray) -> None:
        """Isotonic regression of the examples' labels on their votes by all other examples; the labels weigh as in the corpus."""
        votes, own = [], []
        for lo, hi in zip(*_runs(d), strict=True):
            e, s = self.nearest(t[lo:hi], x[lo:hi], NEIGHBOURS + 1)
            other = np.flatnonzero(e != d[lo])[:NEIGHBOURS]
            votes.append(self._vote(e[other], s[other]))
            own.append(int(d[lo]))
        y = self.label[own]
        share = self.label.mean() if len(self.label) else 0.0
        weight = np.where(y == 1, self.base_rate / max(share, 1e-9), (1 - self.base_rate) / max(1 - share, 1e-9))
        pools: list[list[float]] = []  # weight, weighted labels, weighted votes
        for i in np.argsort(votes, kind="stable").tolist():
            pools.append([weight[i], weight[i] * y[i], weight[i] * votes[i]])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        self.at = [0.0, *(p[2] / p[0] for p in pools if p[0] > 0), 1.0]
        self.to = [0.0, *((p[1] + self.base_rate) / (p[0] + 1) for p in pools if p[0] > 0), 1.0]
        self.to = np.maximum.accumulate(self.to)
        self.read = 0

    def calibrated(self, vote: float) -> float:
        """The share of positives at a vote; a hundredth of the vote itself keeps the order within a level."""
        return 0.99 * float(np.interp(vote, self.at, self.to)) + 0.01 * vote

    def nearest(self, t: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples with the largest positive cosine, ties by example number. `read` counts the blocks that are read."""
        n = self.lead[t + 1] - self.lead[t]
        at = np.repeat(self.lead[t] - np.cumsum(n) + n, n) + np.arange(n.sum())  # the terms' blocks, and the weight of each term
        x, block = np.repeat(x, n), self.block[at]
        bound = np.bincount(block, weights=x * self.top[at], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        e, s, lo, step = np.empty(0, np.int64), np.empty(0), 0, 4
        while lo < len(order):
            kth = np.partition(s, -k)[-k] if len(s) >= k else 0.0
            some = order[lo : lo + step]
            some = some[bound[some] >= max(kth - 1e-12, 1e-12)]  # block-max: all others stay unread
            if not len(some):
                break
            self.read += len(some)
            own = np.isin(block, some)
            p = self.posting[at[own]]
            m = self.posting[at[own] + 1] - p
            post = np.repeat(p - np.cumsum(m) + m, m) + np.arange(m.sum())
            dot = np.bincount(self.example[post], weights=self.weight[post] * np.repeat(x[own], m), minlength=len(self.ids))
            hit = np.flatnonzero(dot)
            e, s = np.concatenate((e, hit)), np.concatenate((s, dot[hit]))
            lo, step = lo + step, 2 * step
        best = np.lexsort((e, -np.round(s, 12)))[:k]
        return e[best], s[best]

    def score(self, batch: list[str | None], k: int) -> tuple[np.ndarray, list[list[dict]]]:
        w = Words(batch, PLAIN, True)
        scores = np.full(len(batch), self.base_rate)
        evidence: list[list[dict]] = [[] for _ in batch]
        if len(self.terms):
            d, t, x = self.weights(w)
            for lo, hi in zip(*_runs(d), strict=True):
                e, s = self.nearest(t[lo:hi], x[lo:hi], k)
                i = int(d[lo])
                scores[i] = self.calibrated(self._vote(e, s))
                evidence[i] = [{"doc_id": a, "cosine": b, "toxic": int(c)} for a, b, c in zip(self.ids[e].tolist(), s.tolist(), self.label[e].tolist(), strict=True)]
        return np.clip(scores, 0.0, 1.0), evidence


def _runs(d: np.ndarray) -> tuple[list[int], list[int]]:
    cut = np.flatnonzero(np.diff(d)) + 1
    edge = [0, *cut.tolist(), len(d)] if len(d) else [0]
    return edge[:-1], edge[1:]


def fit(docs: DataFrame, labels: DataFrame, trained: Column, least_chi: float = LEAST_CHI) -> Model:
    """Fits on a bounded sample (POSITIVE and NEGATIVE ids, drawn by their hash) of the labelled rows that `trained`
    (over doc_id) holds for; document frequencies are counted over all documents. Of rows with one id, the least text counts."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & trained).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = {r[0]: r[1] for r in own.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, POSITIVE / max(1, size.get(1, 0)))).otherwise(min(1.0, NEGATIVE / max(1, size.get(0, 0))))
    drawn = own.where(F.xxhash64("doc_id", F.lit("toxicity")) / F.lit(2.0**64) + 0.5 <= share)
    rows = docs.select("doc_id", "text").where(F.length("text") <= EXAMPLE_CHARS).join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (-r["toxic"], r["doc_id"], r["text"]))
    total = size.get(0, 0) + size.get(1, 0)
    model = Model([r["doc_id"] for r in rows], [r["text"] for r in rows], [r["toxic"] for r in rows], size.get(1, 0) / total if total else 0.0, least_chi)
    texts, model.texts = model.texts, []
    held = docs.sparkSession.sparkContext.broadcast(model)
    model.texts = texts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        df, n = np.zeros(len(m.terms), dtype=np.int64), 0
        for b in slices(batches):
            df += np.bincount(m.counts(Words(b.column(0).to_pylist(), PLAIN, True))[1], minlength=len(df))
            n += b.num_rows
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()], pa.int64()), pa.array([n, *df[some].tolist()], pa.int64())], names=["term", "n"])

    got = {r[0]: r[1] for r in docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect()}
    documents = got.pop(-1, 0)
    return model.index(got, documents)


def score(docs: DataFrame, model: Model, k: int = NEIGHBOURS) -> DataFrame:
    """(doc_id, score, evidence) for every row of docs. A document without any term of the index, an empty and a null
    text get the base rate and no evidence; repeated rows get equal scores."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in slices(batches):
            s, ev = m.score(b.column(1).to_pylist(), k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(ev, kind)], names=["doc_id", "score", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id: long, cosine: double, toxic: int>>")


def keep_clean(docs: DataFrame, model: Model, at: float = 0.7, k: int = NEIGHBOURS) -> DataFrame:
    """The rows of docs, all columns, whose text scores below `at`."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in slices(batches):
            yield b.filter(pa.array(m.score(b.column(where).to_pylist(), k)[0] < at))

    return docs.mapInArrow(run, docs.schema)
