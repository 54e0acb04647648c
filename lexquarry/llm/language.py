"""Language identification by cross-parsing against suffix automata of labelled text.

One suffix automaton per language holds every substring of a bounded sample of its labelled text. A document is
parsed greedily into the longest phrases that a language's sample contains; the language that needs the fewest
phrases wins, each weighted by the log of what it is chosen from (the cross-entropy estimate of Ziv and Merhav): the places of
the sample and the letters of all samples. So a letter that a sample lacks costs at least the log of the alphabet, and a
language with little text can't win by its small size. All lanes of a batch advance one character at a time through
sparse transition tables, so no Python loop runs per character. Every letter of every sample is a class of its own.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import slices

#: Characters that a lane parses; a longer text takes several lanes, whose phrases add up.
LANE = 512
#: Sample of each language: characters in all, whatever the number of languages, and of one span.
SAMPLE_CHARS, DOC_CHARS = 30_000, 600
#: Character classes: a pad, all that is not a letter, letters that no sample has; the letters of the samples follow.
PAD, GAP, OTHER = 0, 1, 2
DEAD = 0xFFFF
#: Draws of a place for a state before its table is made larger.
TRIES = 64


def _states(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of a sequence of class codes."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        if c == PAD:  # between documents: no substring spans two of them
            last = 0
            continue
        if c in go[last] and length[go[last][c]] == length[last] + 1:
            last = go[last][c]
            continue
        p, cur = last, len(go)
        split = c in go[last]
        if not split:
            go.append({})
            length.append(length[last] + 1)
            link.append(0)
            while p >= 0 and c not in go[p]:
                go[p][c] = cur
                p = link[p]
            if p < 0:
                last = cur
                continue
        q = go[p][c]
        if length[q] == length[p] + 1:
            link[cur] = q
        else:
            clone = len(go)
            go.append(dict(go[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            link[q] = clone
            if not split:
                link[cur] = clone
            while p >= 0 and go[p].get(c) == q:
                go[p][c] = clone
                p = link[p]
            if split:
                cur = clone
        last = cur
    return go


def build_automaton(codes: list[int], width: int) -> np.ndarray:
    """Transitions of the suffix automaton of a sequence of class codes, as a (state, class) table; DEAD where there is none."""
    go = _states(codes)
    out = np.full((len(go), width), DEAD, dtype=np.uint16)
    for s, d in enumerate(go):
        for c, t in d.items():
            out[s, c] = t
    return out


def build_sparse(codes: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The same automaton as a pair (owner, target): a state is the number of a place, the first one 0, and state s goes by class c
    to target[s + c] if owner[s + c] is s, and nowhere otherwise. Rows of the table overlap, fullest states placed first."""
    go = _states(codes)
    draw, room = random.Random(1), 2 * sum(map(len, go)) + 1
    place, used, taken = [0] * len(go), set(go[0]), {0}
    for s in sorted(range(1, len(go)), key=lambda s: -len(go[s])):
        tries = 0
        while (at := int(draw.random() * room)) in taken or any(at + c in used for c in go[s]):
            tries += 1
            if tries % TRIES == 0:
                room += room // 4 + 1
        place[s] = at
        taken.add(at)
        used.update(at + c for c in go[s])
    owner = np.full(max(taken) + width, -1, dtype=np.int32)
    target = np.zeros(len(owner), dtype=np.int32)
    for s, d in enumerate(go):
        for c, t in d.items():
            owner[place[s] + c], target[place[s] + c] = place[s], place[t]
    return owner, target


class Model:
    """Tables of the languages that have a letter in their samples; those without one are left out."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.langs = sorted(k for k, v in samples.items() if any(c.isalpha() for t in v for c in t))
        self.letters = {ord(c): i + OTHER + 1 for i, c in enumerate(sorted({c for v in samples.values() for t in v for c in t.lower() if c.isalpha()}))}
        self.width = len(self.letters) + OTHER + 1
        self.tables, self.bits = [], []
        for k in self.langs:
            codes: list[int] = []
            for t in samples[k]:
                if len(codes) >= SAMPLE_CHARS:
                    break
                codes += [*self.codes(t)[: SAMPLE_CHARS - len(codes)].tolist(), PAD]
            self.tables.append(build_sparse(codes, self.width))
            self.bits.append(float(np.log2(len(codes) + self.width)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "lookup"}

    def codes(self, text: str) -> np.ndarray:
        """Class codes of a text: lower-cased letters, and one gap for every run of other characters."""
        p = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if not hasattr(self, "lookup"):
            self.lookup = np.array([OTHER if chr(i).isalpha() else GAP for i in range(0x110000)], dtype=np.int32)
            self.lookup[list(self.letters)] = list(self.letters.values())
        out = self.lookup[p]
        keep = np.ones(len(out), dtype=bool)
        keep[1:] = (out[1:] != GAP) | (out[:-1] != GAP)
        return out[keep]

    def phrases(self, docs: list[np.ndarray]) -> np.ndarray:
        """Phrases that each document takes in each language (documents x languages)."""
        lanes = np.array([-(-len(d) // LANE) for d in docs], dtype=np.int64)
        grid = np.zeros((int(lanes.sum()), LANE), dtype=np.int32)
        flat, at = grid.reshape(-1), 0
        for d, n in zip(docs, lanes.tolist(), strict=True):
            flat[at : at + len(d)] = d
            at += n * LANE
        held = (grid != PAD).sum(axis=1)
        order = np.argsort(-held, kind="stable")  # longest lanes first, so that those still open are always the first ones
        cols = np.ascontiguousarray(grid[order].T)
        still = np.searchsorted(-held[order], -np.arange(LANE), side="left")
        doc = np.repeat(np.arange(len(docs)), lanes)[order]
        out = np.zeros((len(docs), len(self.langs)))
        for k, (owner, target) in enumerate(self.tables):
            start = np.where(owner[: self.width] == 0, target[: self.width], 0)
            alone = owner[: self.width] != 0  # a character that the sample lacks is a phrase of its own
            state = np.zeros(len(grid), dtype=np.int32)
            count = np.ones(len(grid), dtype=np.int64)
            for c, n in zip(cols, still.tolist(), strict=True):
                if n == 0:
                    break
                c, now = c[:n], state[:n]
                place = now + c
                nxt = target.take(place)
                bad = np.flatnonzero(owner.take(place) != now)
                if len(bad):
                    cb = c[bad]
                    count[bad] += (now[bad] != 0) + alone[cb].astype(np.int64)
                    nxt[bad] = start[cb]
                state[:n] = nxt
            out[:, k] = np.bincount(doc, weights=count, minlength=len(docs)) * self.bits[k]
        return out

    def predict(self, batch: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(batch), [0.0] * len(batch)
        docs = {i: c for i, t in enumerate(batch) if t and (c := self.codes(t)).max() > GAP} if self.langs else {}
        has = list(docs)
        if has:
            bits = self.phrases(list(docs.values()))
            other = np.array([np.count_nonzero(c == OTHER) for c in docs.values()])
            bits += other[:, None] * (max(self.bits) - np.array(self.bits))  # letters that no sample has tell nothing apart
            best = bits.argmin(axis=1)
            share = (bits.min(axis=1)[:, None] / np.maximum(bits, 1e-9)) ** 8
            share = share[np.arange(len(has)), best] / share.sum(axis=1)
            for i, k, s in zip(has, best.tolist(), share.tolist(), strict=True):
                langs[i], scores[i] = self.langs[k], s
        return langs, scores


def fit(docs: DataFrame, trained: Column, lang_col: str = "lang") -> Model:
    """Fits on a bounded sample of the labelled rows that `trained` holds for: about SAMPLE_CHARS characters a language, from
    spans of DOC_CHARS characters at hashed places anywhere in the texts of rows drawn by a hash of their id; a language of
    few rows gives several spans a row, or whole texts where these are not longer. Of rows with one id, the least text counts."""
    own = docs.where(trained & F.col(lang_col).isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col(lang_col).cast("string").alias("lang"))
    counts = own.groupBy("lang").count().collect()  # as many rows as languages
    if not counts:
        return Model({})
    want = 3 * SAMPLE_CHARS // DOC_CHARS
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, want / r["count"]))])
    each = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], -(-want // r["count"]))])
    draw = (F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")) / F.lit(2.0**64) + 0.5) <= share[F.col("lang")]
    at = lambda i: F.xxhash64("doc_id", F.lit("span"), i)
    spans = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.struct(at(i).alias("at"), F.substring("text", F.pmod(at(i), F.length("text") - (DOC_CHARS - 1)).cast("int") + 1, F.lit(DOC_CHARS)).alias("text")))
    whole = F.array(F.struct(at(F.lit(1)).alias("at"), F.col("text")))
    drawn = own.where(draw).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).withColumn("n", each[F.col("lang")])
    rows = drawn.select("lang", F.explode(F.when(F.length("text") <= F.col("n") * DOC_CHARS, whole).otherwise(spans)).alias("s")).select("lang", "s.at", "s.text").collect()
    samples: dict[str, list[str]] = {r["lang"]: [] for r in counts}
    for r in sorted(rows, key=lambda r: (r["at"], r["text"])):
        samples[r["lang"]].append(r["text"])
    return Model(samples)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs (doc_id, text). Null texts and texts without a letter get `und` and 0;
    ties go to the first language by name; a model without languages (no labelled text with a letter) gives all rows `und`."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in slices(batches):
            langs, scores = m.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
