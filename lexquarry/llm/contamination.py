"""Benchmark decontamination with a stored, distributed positional inverted index.

1. The documents are read once. Each shard, about SHARD_CHARS characters of documents, becomes one row of the index: the
   words it holds, each with its sorted positions. Only words that test items may have are kept; a bitmap of fixed size tells.
2. The windows of all items (consecutive words) are rows, once for equal words. The index's own counts rank the words of each
   from the rarest on; a window with a word that the corpus lacks is dropped.
3. Windows join the shards that hold their rarest word.
4. Each shard starts from the list of that word and intersects it with the offset-adjusted lists of the others, from the next
   rarest on. What is left are exact phrase matches; proximity matches need all words near the rarest one, in any order.

Index, windows and matches are tables of the session; only the bitmap is broadcast, and nothing that grows reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import map_arrow, salted_join, settle, slices
from ._words import PLAIN, Words, grams, mix

#: Characters of a shard, about; one longer text is a shard of its own.
SHARD_CHARS = 1 << 24
#: Words of item windows that a task hands over at once.
BLOCK_WORDS = 100_000
#: Candidates that are intersected at once.
AT_ONCE = 1 << 20
#: Bits of a hash that the bitmap of the items' words tells apart: 1 MB whatever the items.
BITMAP_BITS = 23
#: Tasks that share the shards of one word; copies of each window.
SALTS = 8
#: Rows below which a table of two or fewer long columns is broadcast: 8 MB at most.
FEW = 500_000

_INDEX = "shard long, ids array<long>, marks array<long>, n_words array<long>, terms array<long>, counts array<long>, body binary"
_WINDOWS = "item string, a long, b long, terms array<long>"
_MATCHES = "shard long, at int, doc_id long, mark long, n_words long, n_hit long, a array<long>, b array<long>, near_a array<long>, near_b array<long>"


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item, a, b, terms): every window of every item, its words as hashes and two digests of their sequence. An item with fewer
    words is one window. Items without id or text have none."""
    own = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = Words(batch.column(1).to_pylist(), PLAIN, True)
            for i, item in enumerate(batch.column(0).to_pylist()):
                h = w.hash[w.first[i] : w.first[i + 1]]
                if not len(h):
                    continue
                k = min(window, len(h))
                a, b = (mix(grams(x, k) + np.uint64(k)).view(np.int64) for x in (h, mix(h)))
                rows = np.lib.stride_tricks.sliding_window_view(h.view(np.int64), k)
                step = max(1, BLOCK_WORDS // k)
                for lo in range(0, len(rows), step):
                    part = rows[lo : lo + step]
                    terms = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * k), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), pa.array(a[lo : lo + step]), pa.array(b[lo : lo + step]), terms], names=["item", "a", "b", "terms"])

    return own.mapInArrow(run, _WINDOWS)


def _bitmap(terms: DataFrame) -> np.ndarray:
    """The bitmap of a column `term` of hashes, packed: gathered as 2 ** BITMAP_BITS bits, however many terms there are."""
    slot = F.shiftrightunsigned("term", 64 - BITMAP_BITS) + 1
    got = terms.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect()
    out = np.zeros((1 << BITMAP_BITS) // 8, dtype=np.uint8)
    for r in got:
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out


def build_index(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """One row a shard of docs (doc_id, text, mark): ids, marks and numbers of words of its documents, and for each word that the
    bitmap lets pass (terms, ascending) its occurrences (counts) and positions in the shard (body, as differences)."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(held.value, bitorder="little").view(bool)
        first = TaskContext.get().partitionId() << 32
        made, size, parts = 0, 0, []

        def shard() -> pa.RecordBatch:
            ids, marks = (pa.concat_arrays([p[i] for p in parts]) for i in (0, 1))
            n = np.concatenate([p[2] for p in parts])
            base = np.cumsum([0, *[int(p[2].sum()) for p in parts[:-1]]])
            pos = np.concatenate([p[3] + lo for p, lo in zip(parts, base.tolist(), strict=True)])
            h = np.concatenate([p[4] for p in parts])
            order = np.argsort(h, kind="stable")
            terms, at, counts = np.unique(h[order], return_index=True, return_counts=True)
            pos = pos[order]
            steps = np.diff(pos, prepend=0)
            steps[at] = pos[at]
            one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64())) for x in (ids, marks, n, terms, counts)]
            body = pa.array([zlib.compress(steps.astype("<u4").tobytes(), 1)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), *one, body], names=["shard", "ids", "marks", "n_words", "terms", "counts", "body"])

        for b in slices(batches):
            w = Words(b.column(1).to_pylist(), PLAIN, True)
            pos = np.flatnonzero(known[(w.hash >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)])
            parts.append((b.column(0), b.column(2), w.counts(), pos, w.hash[pos].view(np.int64)))
            size += len(w.buf)
            if size >= SHARD_CHARS:
                yield shard()
                made, size, parts = made + 1, 0, []
        if parts:
            yield shard()

    return docs.mapInArrow(run, _INDEX)


def ranked_windows(windows: DataFrame, index: DataFrame) -> DataFrame:
    """(a, b, lead, offsets, terms): distinct windows with all words in the corpus, their words from the rarest on; `lead` is the rarest."""
    freq = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("n"))
    own = windows.groupBy("a", "b").agg(F.any_value("terms").alias("terms"))
    each = own.select("a", "b", F.size("terms").alias("k"), F.posexplode("terms").alias("o", "term"))
    ranked = salted_join(each, freq, ["term"], ["a", "b"]).groupBy("a", "b", "k").agg(F.array_sort(F.collect_list(F.struct("n", "o", "term"))).alias("r")).where(F.size("r") == F.col("k"))
    return ranked.select("a", "b", F.get("r", F.lit(0))["term"].alias("lead"), F.transform("r", lambda x: x["o"]).alias("offsets"), F.transform("r", lambda x: x["term"]).alias("terms"))


class Shard:
    """A shard's posting lists, and the windows (one row each) to look for in it."""

    def __init__(self, row: dict, a: np.ndarray, b: np.ndarray, offsets: list, terms: list) -> None:
        self.first = np.concatenate(([0], np.cumsum(np.array(row["n_words"], dtype=np.int64)))).astype(np.int64)
        self.terms, counts = np.array(row["terms"], dtype=np.int64), np.array(row["counts"], dtype=np.int64)
        self.lead = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        steps = np.frombuffer(zlib.decompress(row["body"]), dtype="<u4").astype(np.int64)
        total = np.concatenate(([0], np.cumsum(steps))).astype(np.int64)
        self.pos = total[1:] - np.repeat(total[self.lead[:-1]], counts)
        self.span = int(self.first[-1]) + 1
        self.keys = np.repeat(np.arange(len(counts)), counts) * self.span + self.pos  # ascending: by word, then by position
        length = np.array([len(t) for t in terms], dtype=np.int64)
        wide = int(length.max()) if len(length) else 1
        flat = np.array([x for t in terms for x in t], dtype=np.int64)
        at = np.minimum(np.searchsorted(self.terms, flat), max(0, len(self.terms) - 1))
        ok = self.terms[at] == flat if len(self.terms) else np.zeros(len(flat), dtype=bool)
        own = np.repeat(np.arange(len(length)), length)
        column = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        self.term, self.offset = np.full((len(length), wide), -1, dtype=np.int64), np.zeros((len(length), wide), dtype=np.int64)
        self.term[own, column], self.offset[own, column] = at, [x for o in offsets for x in o]
        whole = np.bincount(own, weights=~ok, minlength=len(length)) == 0  # all words are in the shard
        self.a, self.b, self.length = a[whole], b[whole], length[whole]
        self.term, self.offset = self.term[whole], self.offset[whole]

    def _starts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows and the positions of their rarest words, AT_ONCE at most at a time."""
        lo, n = self.lead[self.term[:, 0]], self.lead[self.term[:, 0] + 1] - self.lead[self.term[:, 0]]
        upto = np.cumsum(n)
        i = skip = 0
        while i < len(n):
            if n[i] - skip > AT_ONCE:  # one list alone may be longer
                yield np.full(AT_ONCE, i), self.pos[lo[i] + skip : lo[i] + skip + AT_ONCE]
                skip += AT_ONCE
                continue
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + AT_ONCE, side="right")))
            m = n[i:j].copy()
            m[0] -= skip
            f = lo[i:j].copy()
            f[0] += skip
            yield np.repeat(np.arange(i, j), m), self.pos[np.repeat(f - np.cumsum(m) + m, m) + np.arange(m.sum())]
            i, skip = j, 0

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """Exact matches: windows, and the positions at which they start."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for win, p in self._starts():
            start = p - self.offset[win, 0]
            doc = np.searchsorted(self.first, p, side="right") - 1
            ok = (start >= self.first[doc]) & (start + self.length[win] <= self.first[doc + 1])
            win, start = win[ok], start[ok]
            for j in range(1, self.term.shape[1]):
                if not len(win):
                    break
                want = self.term[win, j]
                key = want * self.span + start + self.offset[win, j]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                ok = (want < 0) | (self.keys[at] == key)
                win, start = win[ok], start[ok]
            found.append((win, start))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def proximity(self, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """Near matches: windows, and the positions of the rarest word with all others at most the window's length and `slack`
        words away in the same document, in any order."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for win, p in self._starts():
            for j in range(1, self.term.shape[1]):
                if not len(win):
                    break
                want, reach = self.term[win, j], self.length[win] - 1 + slack
                doc = np.searchsorted(self.first, p, side="right") - 1
                lo = want * self.span + np.maximum(p - reach, self.first[doc])
                hi = want * self.span + np.minimum(p + reach, self.first[doc + 1] - 1)
                ok = (want < 0) | (np.searchsorted(self.keys, lo) < np.searchsorted(self.keys, hi, side="right"))
                win, p = win[ok], p[ok]
            found.append((win, p))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def matches(docs: DataFrame, items: DataFrame, window: int, slack: int | None) -> tuple[DataFrame, DataFrame]:
    """Per row of docs (doc_id, text, mark) its words, words in matches and windows (a, b) that occur in it; and the items' windows."""
    windows = settle(item_windows(items, window))
    index = settle(build_index(docs, _bitmap(windows.select(F.explode("terms").alias("term")))))
    ranked = settle(ranked_windows(windows, index))
    leads = ranked.select("lead").distinct()
    leads = F.broadcast(leads) if leads.count() <= FEW else leads
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS))
    held = index.select(F.col("shard").alias("of"), F.explode("terms").alias("lead")).join(leads, "lead", "left_semi").withColumn("salt", salt("of"))
    asked = held.join(ranked.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["lead", "salt"]).select("of", "a", "b", "offsets", "terms")

    def intersect(key: tuple, shard: pa.Table, w: pa.Table) -> pa.Table:
        row = shard.to_pylist()[0]
        s = Shard(row, *(w.column(c).to_numpy().astype(np.int64) for c in ("a", "b")), w.column("offsets").to_pylist(), w.column("terms").to_pylist())
        win, start = s.phrases()
        edge = np.zeros(s.span, dtype=np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + s.length[win], -1)
        n = np.diff(s.first)
        hit = np.bincount(np.repeat(np.arange(len(n)), n)[np.cumsum(edge[:-1]) > 0], minlength=len(n))
        lists = []
        for ws, ps in ((win, start), s.proximity(slack) if slack is not None else (win[:0], start[:0])):
            many = max(1, len(s.a))
            pairs = np.unique((np.searchsorted(s.first, ps, side="right") - 1) * many + ws)  # a document and a window once
            cut = pa.array(np.searchsorted(pairs // many, np.arange(len(n) + 1)).astype(np.int32))
            lists += [pa.ListArray.from_arrays(cut, pa.array(x[pairs % many])) for x in (s.a, s.b)]
        cols = [pa.array(np.full(len(n), row["shard"])), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(row["ids"], pa.int64()), pa.array(row["marks"], pa.int64()), pa.array(n), pa.array(hit), *lists]
        return pa.table(cols, names=[c.split()[0] for c in _MATCHES.split(", ")])

    return settle(index.groupBy("shard").cogroup(asked.groupBy("of")).applyInArrow(intersect, _MATCHES)), windows


def _is_contaminated(min_share: float) -> Column:
    return (F.col("n_hit") > 0) & (round(1 / min_share) * F.col("n_hit") >= F.col("n_words"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, min_share: float = 0.05, slack: int | None = None) -> DataFrame:
    """Per document: n_words, the words inside any occurrence of an item's window (n_hit), the items with such windows,
    and whether it is contaminated (n_hit > 0 and n_hit >= min_share of the words). With `slack`, near_items counts the
    items of which a window also has a proximity match.

    A null or empty text has no words and no hits; repeated rows are judged one by one; equal item ids count as one item; no item: no hits.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("mark"))
    found, windows = matches(docs, items, window, slack)
    holders = windows.select("a", "b", "item").distinct()
    none = F.array().cast("array<string>")

    def listed(a: str, b: str, name: str) -> DataFrame:
        each = found.where(F.size(a) > 0).select("shard", "at", F.explode(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))).alias("x")).select("shard", "at", "x.a", "x.b")
        return salted_join(each, holders, ["a", "b"], ["shard", "at"]).groupBy("shard", "at").agg(F.array_sort(F.collect_set("item")).alias(name))

    out = found.join(listed("a", "b", "items"), ["shard", "at"], "left")
    near = F.lit(None).cast("long")
    if slack is not None:
        out = out.join(listed("near_a", "near_b", "near"), ["shard", "at"], "left")
        near = F.size(F.coalesce("near", none)).cast("long")
    return out.select("doc_id", "n_words", "n_hit", F.coalesce("items", none).alias("items"), _is_contaminated(min_share).alias("contaminated"), near.alias("near_items"))


def keep_uncontaminated(docs: DataFrame, items: DataFrame, window: int = 13, min_share: float = 0.05) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated; rows with equal ids and texts stay or go together."""
    mark = F.xxhash64(F.col("text").cast("string"))
    found, _ = matches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), mark.alias("mark")), items, window, None)
    bad = found.where(_is_contaminated(min_share)).select(F.col("doc_id").alias("_bad_id"), F.col("mark").alias("_bad_mark")).distinct()
    bad = F.broadcast(bad) if bad.count() <= FEW else bad
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("_bad_id")) & (mark == F.col("_bad_mark")), "left_anti")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index in readable form: (term, doc_id, positions) for the words of `terms` (term: string), one row per word and document."""
    wanted = terms.select(F.col("term").cast("string").alias("term")).distinct()

    def f(b: pa.RecordBatch) -> dict:
        ids, w = b.column(0).to_pylist(), Words(b.column(1).to_pylist(), PLAIN, True)
        rows: dict[tuple[str, int], list[int]] = {}
        for i in range(len(w)):
            for j in range(int(w.first[i]), int(w.first[i + 1])):
                rows.setdefault((w.buf[w.start[j] : w.end[j]].decode("utf-8", "replace"), i), []).append(j - int(w.first[i]))
        return {"term": [k[0] for k in rows], "doc_id": [ids[k[1]] for k in rows], "positions": list(rows.values())}

    return map_arrow(docs, f, "term string, doc_id long, positions array<int>").join(wanted, "term", "left_semi")
