"""Removal of passages that a document with a smaller id also holds, by suffix automata of reference shards.

Documents are dealt to blocks by a hash of their id and text; blocks and shards grow with the root of the input, so that their messages
grow with the input (`_sizes`). Four exchanges between blocks and shards find and settle what repeats:

1. each block sends the anchors of its windows to shards by anchor (an anchor is the least word 5-gram hash of a
   window, so equal windows have equal anchors), one row a block and shard;
2. shards answer each block with the anchors that another document also has, and which of them are hot: held by
   more than HOT distinct windows, such as those over a short line that many documents have between other words;
3. blocks send the passages around those anchors, as words, to the shards that own the anchors; a shard's passages
   are its reference text, equal passages once. The shard builds a suffix automaton of them, in ascending order of their
   first document, some anchors at a time, and streams every passage through it: the matching statistics give, for every window, the
   smallest document that holds its words. Each window over a hot anchor is a passage of its own and goes by the hash of all
   its words, so such windows spread over all shards and only equal ones meet;
4. blocks remove the maximal spans of windows that a smaller document holds.

All rows between blocks and shards are compressed arrays. A passage that thousands of documents share arrives once
from each block, and its copies in a shard are one string; passages that differ meet in a shard only below HOT windows
an anchor. So no task holds all occurrences of anything.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import texts
from ._words import SPACED, Words, grams

#: Words of an anchor. Longer anchors repeat less by chance, shorter ones are fewer.
ANCHOR = 5
#: Least characters in a block, about; blocks for each shard; characters in a block for each of its messages to shards.
BLOCK_CHARS, BLOCKS_PER_SHARD, MESSAGE_CHARS = 200_000, 2, 4_000
#: Words of passages in an automaton, about.
AUTOMATON_WORDS = 100_000
#: Distinct windows of an anchor beyond which it is hot.
HOT = 20_000
#: Id of rows without one: after all others.
NO_ID = 2**63 - 1

_MESSAGE = "to long, block long, kind int, body binary"
_SCHEMA = pa.schema([("to", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("body", pa.binary())])


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 8-byte numbers as bytes, compressed unless they are few: in a very large corpus a message may hold one anchor."""
    raw = b"".join(len(a).to_bytes(4, "little") + a.astype(np.int64 if a.dtype != np.uint64 else np.uint64).tobytes() for a in arrays)
    return b"z" + zlib.compress(raw, 1) if len(raw) > 128 else b"r" + raw


def _unpack(b: bytes) -> list[np.ndarray]:
    b, at, out = zlib.decompress(b[1:]) if b[:1] == b"z" else b[1:], 0, []
    while at < len(b):
        n = int.from_bytes(b[at : at + 4], "little")
        out.append(np.frombuffer(b, dtype=np.int64, count=n, offset=at + 4) if n else np.empty(0, np.int64))
        at += 4 + 8 * n
    return out


def _message(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.table([pa.array(c, type=f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)


def _sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Least of every k consecutive values."""
    done = 1
    while done < k:
        step = min(done, k - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def _windows(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The first words of all windows that lie in one document, and the windows' anchors."""
    if len(w.hash) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    k = min(ANCHOR, window)
    anchors = _sliding_min(grams(w.hash, k), window - k + 1)[: len(w.hash) - window + 1]
    n = w.counts()
    starts = np.concatenate([np.arange(a, a + max(0, c - window + 1)) for a, c in zip(w.first[:-1].tolist(), n.tolist(), strict=True)] or [np.empty(0, np.int64)]).astype(np.int64)
    return starts, anchors[starts].view(np.int64)


def _shard(anchor: np.ndarray, shards: int) -> np.ndarray:
    return ((anchor.view(np.uint64) >> np.uint64(17)) % np.uint64(shards)).astype(np.int64)


def _sizes(chars: int, blocks: int | None = None) -> tuple[int, int]:
    """Blocks and shards for so many characters. A message goes from each block to each shard: about one for every MESSAGE_CHARS characters."""
    blocks = blocks or max(1, min(chars // BLOCK_CHARS, math.isqrt(chars * BLOCKS_PER_SHARD // MESSAGE_CHARS)))
    return blocks, max(1, blocks // BLOCKS_PER_SHARD)


class _Block:
    """A block's documents, ascending by id."""

    def __init__(self, t: pa.Table, window: int) -> None:
        ids = t.column("doc_id").to_pylist()
        body = t.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, body[i] or ""))
        self.ids = [ids[i] for i in order]
        self.key = np.array([NO_ID if ids[i] is None else ids[i] for i in order], dtype=np.int64)
        self.words = Words([body[i] for i in order], SPACED, False)
        self.start, self.anchor = _windows(self.words, window)
        self.doc = self.key[self.words.doc_of_word()[self.start]] if len(self.start) else np.empty(0, np.int64)

    def grams(self, window: int) -> np.ndarray:
        """Hashes of the words of all windows."""
        return grams(self.words.hash, window)[self.start].view(np.int64)

    def passages(self, repeated: np.ndarray, hot: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows with one repeated anchor: first window (number), windows, anchor, and a hash of the run's words.
        A window with a hot anchor is a run of its own, and the hash of its words stands for its anchor."""
        ok = np.isin(self.anchor, repeated)
        new = np.ones(len(ok), dtype=bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.start[1:] != self.start[:-1] + 1)
        anchor = self.anchor
        if len(hot):
            alone = np.isin(anchor, hot)
            new |= alone
            anchor = np.where(alone, self.grams(window), anchor)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(ok)))
        first, size = first[ok[first]], size[ok[first]]
        a, n = self.start[first], size + window - 1
        longest = np.argsort(-n, kind="stable")  # word j is looked up in the runs that have it
        at, own = a[longest], np.zeros(len(a), dtype=np.uint64)
        mult = np.uint64(0x9E3779B97F4A7C15)
        for j, c in enumerate(np.searchsorted(-n[longest], -np.arange(int(n.max()) if len(n) else 0)).tolist()):
            own[:c] = (own[:c] ^ self.words.hash[at[:c] + j]) * mult + np.uint64(j)
        key = np.empty_like(own)
        key[longest] = own
        return first, size, anchor[first], key.view(np.int64)


def _notes(anchor: np.ndarray, gram: np.ndarray, several: np.ndarray) -> np.ndarray:
    """For each distinct anchor of a block, ascending: the count of its distinct windows, whether several documents of the
    block have it, and 16 bits that blocks with equal windows share."""
    order = np.lexsort((gram, anchor))
    a, g = anchor[order], gram[order]
    new = np.append(True, (a[1:] != a[:-1]) | (g[1:] != g[:-1]))
    a, g = a[new], g[new]
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    n = np.diff(np.append(first, len(a)))
    return n << 17 | several.astype(np.int64) << 16 | np.add.reduceat(g, first) & 0xFFFF


def _judge(anchor: np.ndarray, note: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each anchor that blocks sent is repeated, and whether it is hot; windows of blocks with equal bits count once."""
    u, inv = np.unique(anchor, return_inverse=True)
    n, bits = note >> 17, note & 0xFFFF
    repeated = np.bincount(inv, weights=1 + (note >> 16 & 1), minlength=len(u)) > 1
    much = np.bincount(inv, weights=n, minlength=len(u)) > hot
    if much.any():
        at = np.flatnonzero(much[inv])
        at = at[np.unique(inv[at] << 16 | bits[at], return_index=True)[1]]
        much = np.bincount(inv[at], weights=n[at], minlength=len(u)) > hot
    return repeated[inv], (repeated & much)[inv]


class Automaton:
    """Suffix automaton of word sequences added in ascending order of their document; every state knows the first of them."""

    def __init__(self) -> None:
        self.go: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.doc = [-1], [0], [0]

    def _state(self, go: dict, length: int, link: int, doc: int) -> int:
        self.go.append(go)
        self.length.append(length)
        self.link.append(link)
        self.doc.append(doc)
        return len(self.go) - 1

    def add(self, words: list[bytes], doc: int) -> None:
        go, link, length = self.go, self.link, self.length
        last = 0
        for c in words:
            q = go[last].get(c)
            if q is not None:
                if length[q] != length[last] + 1:
                    q = self._clone(last, c, q)
                last = q
                continue
            cur = self._state({}, length[last] + 1, 0, doc)
            p = last
            while p >= 0 and c not in go[p]:
                go[p][c] = cur
                p = link[p]
            if p >= 0:
                q = go[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = cur

    def _clone(self, p: int, c: bytes, q: int) -> int:
        go, link = self.go, self.link
        new = self._state(dict(go[q]), self.length[p] + 1, link[q], self.doc[q])
        link[q] = new
        while p >= 0 and go[p].get(c) == q:
            go[p][c] = new
            p = link[p]
        return new

    def first_docs(self, words: list[bytes], window: int) -> list[int]:
        """Matching statistics: for every window of words that the automaton has, the smallest document with it; -1 without one."""
        go, link, length = self.go, self.link, self.length
        s = n = 0
        out = []
        for i, c in enumerate(words):
            while s and c not in go[s]:
                s = link[s]
                n = length[s]
            if c in go[s]:
                s = go[s][c]
                n += 1
            while n > window and length[link[s]] >= window:
                s = link[s]
                n = length[s]
            if i + 1 >= window:
                out.append(self.doc[s] if n >= window else -1)
        return out


def _first_docs(known: dict[bytes, list], window: int) -> dict[bytes, list[int]]:
    """For each passage (first document, anchor) the smallest document with each of its windows. Passages of different anchors share no window,
    so an automaton takes those of some anchors, and none takes an anchor's only passage."""
    of: dict[int, list[bytes]] = {}
    for x, (_, a) in known.items():
        of.setdefault(a, []).append(x)
    out: dict[bytes, list[int]] = {}
    part: list[bytes] = []
    words = 0
    for i, own in enumerate(of.values(), 1):
        if len(own) == 1:
            out[own[0]] = [known[own[0]][0]] * (own[0].count(b" ") + 2 - window)
        else:
            part += own
            words += sum(x.count(b" ") + 1 for x in own)
        if part and (words >= AUTOMATON_WORDS or i == len(of)):
            m = Automaton()
            for x in sorted(part, key=lambda y: known[y][0]):
                m.add(x.split(b" "), known[x][0])
            out |= {x: m.first_docs(x.split(b" "), window) for x in part}
            part, words = [], 0
    return out


def repeats(docs: DataFrame, window: int = 13, blocks: int | None = None, hot: int = HOT) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256, and the removed spans of words (start, end).

    A word goes if a window over it also starts in a document with a smaller doc_id, as judged on the whole input. Rows
    with equal ids don't count as earlier than each other; a null id counts as the largest; a null or empty text has no words.
    """
    docs = texts(docs)
    blocks, shards = _sizes(0 if blocks else docs.agg(F.sum(F.length("text"))).first()[0] or 0, blocks)
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    def offer(key: tuple, t: pa.Table) -> pa.Table:
        b = _Block(t, window)
        order = np.lexsort((b.doc, b.anchor))
        a, d = b.anchor[order], b.doc[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = a[1:] != a[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(a)) - 1
        a, lo, hi = a[first], d[first] if len(a) else d, d[last] if len(a) else d
        if not len(a):
            return _message([])
        s, note = _shard(a, shards), _notes(b.anchor, b.grams(window), lo != hi)
        order = np.argsort(s, kind="stable")
        k, at = np.unique(s[order], return_index=True)
        return _message([(x, key[0].as_py(), 0, _pack(*part)) for x, *part in zip(k.tolist(), np.split(a[order], at[1:]), np.split(note[order], at[1:]), strict=True)])

    def answer(key: tuple, t: pa.Table) -> pa.Table:
        block = t.column("block").to_pylist()
        got = [_unpack(x) for x in t.column("body").to_pylist()]
        a = np.concatenate([g[0] for g in got])
        own = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
        ok, much = _judge(a, np.concatenate([g[1] for g in got]), hot)
        a, own, much = a[ok], own[ok], much[ok]  # in the order of the messages
        if not len(a):
            return _message([])
        i, at = np.unique(own, return_index=True)
        return _message([(block[x], key[0].as_py(), 1, _pack(part, part[m])) for x, part, m in zip(i.tolist(), np.split(a, at[1:]), np.split(much, at[1:]), strict=True)])

    def send(key: tuple, t: pa.Table, m: pa.Table) -> pa.Table:
        b = _Block(t, window)
        if not m.num_rows:
            return _message([])
        bodies = [_unpack(x) for x in m.column("body").to_pylist()]
        first, size, anchor, h = b.passages(np.concatenate([x[0] for x in bodies]), np.concatenate([x[1] for x in bodies]), window)
        doc = b.doc[first]
        order = np.lexsort((doc, h))
        order = order[np.append(True, h[order][1:] != h[order][:-1])] if len(order) else order  # equal passages of the block once, with their first document
        s = _shard(anchor[order], shards)
        by = np.argsort(s, kind="stable")
        shard, at = np.unique(s[by], return_index=True)
        w = b.words
        rows = []
        for k, own in zip(shard.tolist(), np.split(order[by], at[1:]), strict=False):
            body = [w.buf[w.start[b.start[f]] : w.end[b.start[f] + n + window - 2]] for f, n in zip(first[own].tolist(), size[own].tolist(), strict=True)]
            head = _pack(h[own], doc[own], anchor[own])
            rows.append((k, key[0].as_py(), 2, len(head).to_bytes(8, "little") + head + zlib.compress(b"\n".join(b" ".join(x.split()) for x in body), 1)))
        return _message(rows)

    def match(key: tuple, t: pa.Table) -> pa.Table:
        block = t.column("block").to_pylist()
        known: dict[bytes, list] = {}  # passage: first document, anchor
        each = []
        for raw in t.column("body").to_pylist():
            n = int.from_bytes(raw[:8], "little")
            h, doc, anchor = (x.tolist() for x in _unpack(raw[8 : 8 + n]))
            p = zlib.decompress(raw[8 + n :]).split(b"\n")
            each.append((h, p))
            for x, d, a in zip(p, doc, anchor, strict=True):
                got = known.get(x)
                if got is None:
                    known[x] = [d, a]
                elif d < got[0]:
                    got[0] = d
        answers = _first_docs(known, window)
        rows = []
        for i, (h, p) in zip(block, each, strict=True):
            least = [answers[x] for x in p]
            n = np.array([len(x) for x in least], dtype=np.int64)
            rows.append((i, key[0].as_py(), 3, _pack(np.array(h, dtype=np.int64), n, np.array([y for x in least for y in x], dtype=np.int64))))
        return _message(rows)

    def cut(key: tuple, t: pa.Table, m: pa.Table) -> pa.Table:
        b = _Block(t, window)
        gone = np.zeros(len(b.words.hash) + 1, dtype=np.int64)
        kinds = m.column("kind").to_pylist()
        bodies = [_unpack(x) for x in m.column("body").to_pylist()]
        repeated = [x for k, x in zip(kinds, bodies, strict=True) if k == 1]
        if repeated:
            first, size, _, h = b.passages(np.concatenate([x[0] for x in repeated]), np.concatenate([x[1] for x in repeated]), window)
            replies = [x for k, x in zip(kinds, bodies, strict=True) if k == 3]
            rh = np.concatenate([x[0] for x in replies])
            rn = np.concatenate([x[1] for x in replies])
            least = np.concatenate([x[2] for x in replies])
            rs = np.cumsum(rn) - rn
            order = np.argsort(rh, kind="stable")
            at = order[np.searchsorted(rh, h, sorter=order)]
            win = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            low = least[np.repeat(rs[at], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
            hit = b.start[win[low < b.doc[win]]]
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + window, -1)
        gone = np.cumsum(gone[:-1]) > 0
        w = b.words
        rows = []
        for i, k in enumerate(b.ids):
            lo, hi = int(w.first[i]), int(w.first[i + 1])
            off = gone[lo:hi]
            text = w.buf[w.base[i] : w.base[i + 1] - 1].split()
            if off.any():
                edge = np.flatnonzero(np.diff(off.astype(np.int8), prepend=0, append=0)).tolist()
                text = [x for x, g in zip(text, off.tolist(), strict=True) if not g]
            else:
                edge = []
            rows.append((k, hi - lo, int(off.sum()), hashlib.sha256(b" ".join(text)).hexdigest(), [{"start": s, "end": e} for s, e in zip(edge[0::2], edge[1::2], strict=True)]))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds_ = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        return pa.table([pa.array(c, type=k) for c, k in zip(cols, kinds_, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])

    offers = docs.groupBy("block").applyInArrow(offer, _MESSAGE)
    answers = offers.groupBy("to").applyInArrow(answer, _MESSAGE).withColumnRenamed("to", "at")
    by = docs.groupBy("block")
    sent = by.cogroup(answers.groupBy("at")).applyInArrow(send, _MESSAGE)
    replies = sent.groupBy("to").applyInArrow(match, _MESSAGE).withColumnRenamed("to", "at")
    return by.cogroup(answers.unionByName(replies).groupBy("at")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start: long, end: long>>")
