"""Vectorised word splitting and hashing for Arrow batches of texts.

All functions work on whole texts. A batch is turned into one byte buffer; words are runs of bytes that a
256-entry table marks as word bytes (UTF-8 continuation bytes always are), so no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at once; bounds the working memory of a batch whatever the texts' lengths.
PIECE = 1 << 21

_rng = np.random.default_rng(0x5EED_0001)
_BYTE = _rng.integers(1, 2**64 - 1, size=256, dtype=np.uint64)
_P = int(_rng.integers(1, 2**63, dtype=np.uint64)) * 2 + 1 & (2**64 - 1)
_PINV = pow(_P, -1, 2**64)
_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get("p", ())) < n:
        for k, base in (("p", _P), ("q", _PINV)):
            x = np.full(n, base, dtype=np.uint64)
            x[0] = 1
            _pow[k] = np.cumprod(x, dtype=np.uint64)
    return _pow["p"][:n], _pow["q"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def table(separators: bytes) -> np.ndarray:
    """True for the bytes of words."""
    out = np.ones(256, dtype=bool)
    out[list(separators)] = False
    return out


#: Words are runs of `[^\x20\x09-\x0D]`.
SPACED = table(bytes([0x20, *range(0x09, 0x0E)]))
#: Words are runs of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`, after lower-casing A-Z.
PLAIN = table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words of several texts: `hash` (uint64), byte `start` and `end` in `buf`, and `first`, where text i has words first[i] to first[i + 1]."""

    __slots__ = ("buf", "hash", "start", "end", "first", "base")

    def __init__(self, texts: list[str | None], word: np.ndarray, lower: bool) -> None:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.buf = b" ".join([*raw, b""])
        a = np.frombuffer(self.buf, dtype=np.uint8)
        if lower:
            a = _LOWER[a]
            self.buf = a.tobytes()
        self.base = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw], dtype=np.int64))).astype(np.int64)
        inside = word[a]
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        self.start, self.end = edge[0::2], edge[1::2]
        self.hash = self._hash(self.start, self.end)
        self.first = np.searchsorted(self.start, self.base)

    def _hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges, which ascend and may not overlap."""
        a = np.frombuffer(self.buf, dtype=np.uint8)
        out = np.empty(len(start), dtype=np.uint64)
        i = 0
        while i < len(out):
            lo = int(start[i])
            j = max(i + 1, int(np.searchsorted(end, lo + PIECE, side="right")))
            s, e = start[i:j] - lo, end[i:j] - lo
            n = int(e[-1])
            p, q = _powers(max(n, 1 << 16))
            c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[a[lo : lo + n]] * p[:n], dtype=np.uint64)))
            out[i:j] = mix((c[e] - c[s]) * q[s] + (e - s).astype(np.uint64))
            i = j
        return out

    def prefixes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The words longer than k bytes, and hashes of their first k bytes, which no whole word shares."""
        long = np.flatnonzero(self.end - self.start > k)
        return long, mix(self._hash(self.start[long], self.start[long] + k) + np.uint64(k))

    def __len__(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts())


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words: entry i covers words i to i + k - 1. Ignores text borders."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mix(acc)


def shingle_sets(w: Words, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingles; one for the whole text if it has fewer words; none without words."""
    g = grams(w.hash, k)
    for i in range(len(w)):
        lo, hi = int(w.first[i]), int(w.first[i + 1])
        if hi - lo >= k:
            yield np.unique(g[lo : hi - k + 1])
        elif hi > lo:
            yield mix(grams(w.hash[lo:hi], hi - lo) + np.uint64(hi - lo))
        else:
            yield np.empty(0, np.uint64)
