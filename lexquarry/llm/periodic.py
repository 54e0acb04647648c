"""Runs of words: maximal stretches that repeat with a period, found by an all-lag scan.

For each lag p the word ids are compared with themselves p places on; a stretch of equal places is a run of period p
if it is long enough. A run of lag p holds at least L = max(least - p, p * (exponent - 1)) equal places in a row and
so one at a multiple of L: only those places are compared at first, and whole stretches are followed where they agree.
Nothing is missed by that, and a lag costs n / L comparisons and the lengths of its stretches.

The documents of a batch are scanned together, longest first, with ids of their own, so one comparison serves all that
are long enough for the lag. A long document is dealt over the cluster: each task takes a range of its lags.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import map_arrow, settle, slices, texts

#: Shortest run in words, and repetitions of its period.
LEAST, EXPONENT = 12, 2
#: Characters from which a document's lags are dealt over several tasks, one for each such share of its text.
LONG_CHARS = 1 << 16
#: Characters of the documents that are scanned together.
BATCH_CHARS = 1 << 22

_RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def word_ids(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """One number a word, equal for equal words of one text only; and where each text begins."""
    parts, at = [], 0
    for words in texts:
        number = dict(zip(dict.fromkeys(words), range(at, at + len(words))))  # noqa: B905  fewer distinct words than words
        parts.append(np.fromiter(map(number.__getitem__, words), np.int32 if at < 2**30 else np.int64, len(words)))
        at += len(words)
    return np.concatenate([*parts, np.empty(0, np.int32)]), np.cumsum([0, *map(len, texts)])


def _along(a: np.ndarray, i: int, p: int, step: int) -> int:
    """How many places from i on (or from i back) equal those p words on, without a break."""
    n, got, width = len(a) - p, 0, 64
    while 0 <= i < n:
        lo, hi = (i, min(n, i + width)) if step > 0 else (max(0, i - width + 1), i + 1)
        same = (a[lo:hi] == a[lo + p : hi + p])[::step]
        if not same.all():
            return got + int(same.argmin())
        got += hi - lo
        i += step * (hi - lo)
        width = min(2 * width, 1 << 16)
    return got


def _stretches(b: np.ndarray, p: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and lengths of the stretches of at least `need` places that equal those p words on."""
    at = np.arange(need - 1, len(b) - p, need)
    hits = at[b[need - 1 : len(b) - p : need] == b[need - 1 + p :: need]]
    for h in {1, 2, 3, 4, 5, need // 4, need // 3, need // 2}:
        if not 1 <= h <= need // 2 or not len(hits):
            continue  # a stretch of `need` places goes on for h places to one side at least
        left, right = np.maximum(hits - h, 0), np.minimum(hits + h, len(b) - p - 1)
        hits = hits[(b[left] == b[left + p]) | (b[right] == b[right + p])]
    if not len(hits):
        return hits, hits
    if len(hits) * need * 8 > len(b):  # many: all places are compared
        same = b[: len(b) - p] == b[p:]
        edge = np.concatenate(([0] if same[0] else [], np.flatnonzero(same[1:] != same[:-1]) + 1, [len(same)] if same[-1] else [])).astype(np.int64)
        start, size = edge[0::2], edge[1::2] - edge[0::2]
    else:
        before = _follow(b, hits, p, -1, need)
        own = before < need  # else the place before belongs to the same stretch
        hits, before = hits[own], before[own]
        start, size = hits - before, before + _follow(b, hits, p, 1, len(b)) + 1
    return start[size >= need], size[size >= need]


def _follow(a: np.ndarray, at: np.ndarray, p: int, step: int, most: int) -> np.ndarray:
    """How many places after each of `at` (before it, if step is -1) equal those p words on, without a break; about `most` at most."""
    out = np.zeros(len(at), np.int64)
    alive = np.arange(len(at))
    width, n = 4, len(a)
    while len(alive):
        if len(alive) <= 8:
            for k in alive.tolist():
                out[k] += _along(a, int(at[k] + step * (out[k] + 1)), p, step)
            break
        i = at[alive, None] + step * (out[alive, None] + np.arange(1, width + 1))
        inside = (i >= 0) & (i < n - p)
        i[~inside] = 0
        same = inside & (a[i] == a[i + p])
        whole = same.all(axis=1)
        out[alive] += np.where(whole, width, same.argmin(axis=1))
        alive = alive[whole & (out[alive] < most)]
        width = min(2 * width, max(4, (1 << 20) // max(1, len(alive))))
    return out


def scan(a: np.ndarray, first: np.ndarray, lags: range, least: int = LEAST, exponent: int = EXPONENT) -> list[np.ndarray]:
    """(text, start, length, period) of the runs with a lag in `lags`; texts lie longest first in `a`, from `first` on.
    A run appears with its period and with such multiples of it as fit into it `exponent` times."""
    size = np.diff(first)
    found = []
    for p in lags:
        texts = int(np.searchsorted(-size, -max(least, exponent * p), side="right"))
        if not texts:
            break
        b = a[: first[texts]]
        need = max(least - p, (exponent - 1) * p)
        start, length = _stretches(b, p, need)
        if len(start):
            text = np.searchsorted(first, start, side="right") - 1
            found.append(np.stack([text, start - first[text], length + p, np.full(len(start), p)], axis=1))
    return found


def merged(found: list[np.ndarray]) -> np.ndarray:
    """One row a run, with its smallest period, by text, start and period."""
    found = [x for x in found if len(x)]
    if not found:
        return np.empty((0, 4), np.int64)
    x = np.concatenate(found)
    x = x[np.lexsort((x[:, 3], x[:, 2], x[:, 1], x[:, 0]))]
    x = x[np.concatenate(([True], (np.diff(x[:, :3], axis=0) != 0).any(axis=1)))]
    return x[np.lexsort((x[:, 3], x[:, 1], x[:, 0]))]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without what a run repeats after its first period, joined by spaces."""
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, runs[:, 1] + runs[:, 3], 1)
    np.add.at(step, runs[:, 1] + runs[:, 2], -1)
    if not len(runs):
        return b" ".join(words)
    return b" ".join([w for w, gone in zip(words, (np.cumsum(step)[:-1] > 0).tolist(), strict=True) if not gone])


def repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, of which every tenth one (by the id's CRC) goes on periodically from some word on."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * -(-(n - a) // p))[: n - a]


def _summary(doc_id: int | None, words: list[bytes], runs: np.ndarray) -> tuple:
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs[:, 1:].tolist())
    best = min(runs[:, 1:].tolist(), key=lambda r: (-r[1], r[0], r[2]), default=None)
    start, length, period = best or (None, None, None)
    return doc_id, len(runs), start, length, period, 1000 * length // period if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapse(words, runs)).hexdigest()


def _words(ids: list, found: list, rewrite: bool) -> list[list[bytes]]:
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in found]  # bytes split at \x20 and \x09-\x0D exactly
    return [repeated(d, w) for d, w in zip(ids, split, strict=True)] if rewrite else split


def _columns(rows: list[tuple]) -> dict:
    names = [x.split(" ")[0] for x in _RESULT.split(", ")]
    return dict(zip(names, map(list, zip(*rows, strict=True)) if rows else repeat([]), strict=False))


def periodic_runs(docs: DataFrame, rewrite: bool = False, long_chars: int = LONG_CHARS) -> DataFrame:
    """The runs of every row of docs (doc_id, text): n_runs, the longest one (ties: smallest start, then period), exponent_milli =
    floor(1000 * length / period), a hash of all runs and one of the text without repeated periods.

    Words are runs of characters other than space and \\x09-\\x0D. A run has a smallest period q, max(12, 2 * q) words or more, and
    no neighbouring word extends it with period q. Null and empty texts have no words and no runs. Every row gives one, whether its id is
    null, unique or repeated. With `rewrite` documents are first made periodic by their ids (`repeated`); rows without id never are. Texts
    longer than `long_chars` are scanned by several tasks, the result is the same. Other columns are ignored.
    """
    docs = texts(docs)
    is_long = F.coalesce(F.length("text") > long_chars, F.lit(False))

    def short(b: pa.RecordBatch) -> dict:
        ids = b.column(0).to_pylist()
        words = _words(ids, b.column(1).to_pylist(), rewrite)
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        a, first = word_ids([words[i] for i in order])
        runs = merged(scan(a, first, range(1, len(a) // EXPONENT + 1)))
        at = np.searchsorted(runs[:, 0], np.arange(len(order) + 1))
        return _columns([_summary(ids[i], words[i], runs[at[k] : at[k + 1]]) for k, i in enumerate(order)])

    done = map_arrow(docs.where(~is_long), short, _RESULT, chars=BATCH_CHARS)

    # Long texts: a row for each range of lags, their runs, and the texts once more for the summaries.
    long = docs.where(is_long).withColumn("mark", F.md5("text")).groupBy("doc_id", "mark").agg(F.count("*").alias("copies"), F.any_value("text").alias("text"))
    long = settle(long.withColumn("shares", F.ceil(F.length("text") / F.lit(long_chars)).cast("int")))
    ranges = long.select("doc_id", "mark", "text", "shares", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    ranges = ranges.repartition(F.col("mark"), F.col("share"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1):
            (words,) = _words(b.column(0).to_pylist(), b.column(2).to_pylist(), rewrite)
            shares, share = b.column(3)[0].as_py(), b.column(4)[0].as_py()
            lags = len(words) // EXPONENT
            a, first = word_ids([words])
            runs = merged(scan(a, first, range(1 + lags * share // shares, 1 + lags * (share + 1) // shares)))
            yield pa.RecordBatch.from_pylist([{"doc_id": b.column(0)[0].as_py(), "mark": b.column(1)[0].as_py(), "runs": runs[:, 1:].ravel().tolist()}], pa.schema([("doc_id", pa.int64()), ("mark", pa.string()), ("runs", pa.list_(pa.int64()))]))

    parts = ranges.mapInArrow(some, "doc_id long, mark string, runs array<long>").groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    both = long.select("doc_id", "mark", "text", "copies").join(parts.withColumnsRenamed({"doc_id": "id", "mark": "m"}), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m")))

    def whole(b: pa.RecordBatch) -> dict:
        ids = b.column(0).to_pylist()
        rows = []
        for i, words in enumerate(_words(ids, b.column(1).to_pylist(), rewrite)):
            found = np.array(b.column(2)[i].as_py(), np.int64).reshape(-1, 3)
            rows += [_summary(ids[i], words, merged([np.insert(found, 0, 0, axis=1)]))] * b.column(3)[i].as_py()
        return _columns(rows)

    return done.unionByName(map_arrow(both.select("doc_id", "text", "runs", "copies"), whole, _RESULT))
