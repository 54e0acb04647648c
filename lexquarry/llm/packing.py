"""Best-fit packing of documents into sequences of bounded length, in bulk-synchronous rounds.

Documents are tokenised in parallel. From there on only (length, count) classes matter: a sequence of at most
`capacity` tokens knows `capacity` different lengths, so the table of lengths is bounded whatever the corpus. Each
round takes the longest class of documents that is left, sweeps from it to its successor among the gaps (the least room
that it fits into), fills all gaps of that room at once, resolves by rank which document goes where, and updates the gaps;
new sequences open where no gap fits. The result is that of best-fit over single documents by descending length. The ranks
inside a class, counted in parallel, then give each document its sequence and offset.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import settle, slices, texts

#: Token runs kept by a worker; the table is emptied when it is full.
CACHE = 150_000

#: Binary digits of the number of pieces that are ranked at once.
SLOT_BITS = 14

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Encoder:
    """Byte-pair ids of whole texts, as uint32 bytes.

    The splitting pattern always cuts before a single space that a non-space follows, so a text splits there into
    runs that are encoded alone; a bounded table keeps the ids of frequent runs. Texts with other runs of spaces at
    such a cut go to the library whole.
    """

    def __init__(self, name: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    def run(self, s: str) -> bytes:
        return np.array(self.encode(s), dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        parts = text.split(" ")
        if len(parts) < 3 or any(not p or p[0].isspace() for p in parts[1:]):
            return self.run(text)
        known = self.known
        out = [self.run(parts[0])] if parts[0] else []
        for p in parts[1:]:
            got = known.get(p)
            if got is None:
                if len(known) >= CACHE:
                    known.clear()
                got = self.run(" " + p)
                if len(p) < 64:
                    known[p] = got
            out.append(got)
        return b"".join(out)


_encoders: dict[str, _Encoder] = {}


def tokenise(docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k.tiktoken", end_id: int = 0) -> DataFrame:
    """One row per piece: a document's ids and `end_id`, cut into pieces of `capacity` of which the first may be shorter.
    A null or empty text has the one id `end_id`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, _Encoder(tokenizer))
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in slices(batches):
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = (enc(t) if t else b"") + end
                n = len(ids) // 4
                cut = n - (n - 1) // capacity * capacity
                at = 0
                for i, to in enumerate(range(cut, n + 1, capacity)):
                    rows.append((k, i, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                    at = to
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(cols)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(work, PIECES)


def fills(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Fills sequences with `counts[length]` documents: (length, first rank, sequences, first sequence, offset), by rank, and the
    number of sequences. The documents of a fill go to its sequences in turn: the next layer starts where all have one more."""
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: runs of sequences (first, count)
    rooms: list[int] = []
    opened = 0

    def gap(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in gaps:
                bisect.insort(rooms, room)
            gaps[room].append((first, count))

    for n in sorted((k for k, c in counts.items() if c > 0), reverse=True):
        rank, left = 0, counts[n]
        while left:
            i = bisect.bisect_left(rooms, n)
            room = rooms[i] if i < len(rooms) else capacity
            layers = room // n
            if i < len(rooms):
                first, count = gaps[room].pop()
                if not gaps[room]:
                    del gaps[room]
                    rooms.pop(i)
            else:
                first, count = opened, -(-left // layers)
                opened += count
            whole = min(count, left // layers)  # sequences that take all they can
            for used, deep in ((whole, layers), (1 if count > whole else 0, left - whole * layers)):
                if used and deep:
                    out.append((n, rank, used, first, capacity - room))
                    gap(room - deep * n, first, used)
                    rank, left, first, count = rank + used * deep, left - used * deep, first + used, count - used
            gap(room, first, count)
    return out, opened


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The fills layer by layer: (length, first rank, count, first sequence, offset), one document a sequence."""
    got, opened = fills(counts, capacity)
    out = []
    for (n, rank, used, first, offset), after in zip(got, [*got[1:], (0, 0, 0, 0, 0)], strict=True):
        upto = after[1] if after[0] == n else counts[n]
        out += [(n, r, min(used, upto - r), first, offset + (r - rank) // used * n) for r in range(rank, upto, used)]
    return out, opened


def _step_of(rank: Column, firsts: Column) -> Column:
    """The last place (from 0) of the ascending array whose value is at most `rank`, by halving."""
    half = lambda a: ((a["lo"] + a["hi"]) / 2).cast("int")
    pair = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    step = lambda a, _: F.when(a["hi"] - a["lo"] < 2, a).when(F.get(firsts, half(a)) <= rank, pair(half(a), a["hi"])).otherwise(pair(a["lo"], half(a)))
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(firsts) + 1)).cast("int"))
    return F.aggregate(rounds, pair(F.lit(0), F.size(firsts)), step, lambda a: a["lo"])


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k.tiktoken", end_id: int = 0) -> DataFrame:
    """Every piece with its `sequence_id` and `offset`; sequences are gapless from 0 and hold `capacity` ids at most.

    Nulls, empty texts and repeated rows are packed like any other document; an empty table gives an empty result.
    """
    pieces = settle(tokenise(docs, capacity, tokenizer, end_id).withColumn("row", F.monotonically_increasing_id()))
    pieces = pieces.withColumn("slot", F.shiftright("row", SLOT_BITS))  # consecutive rows of one partition, repeated ones or not
    per = pieces.groupBy("length", "slot").agg(F.count("*").alias("c"))
    base = per.withColumn("base", F.sum("c").over(Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))).select("length", "slot", F.coalesce("base", F.lit(0)).alias("base"))
    counts = {r[0]: r[1] for r in per.groupBy("length").agg(F.sum("c")).collect()}  # at most `capacity` rows
    kinds: dict[int, list] = defaultdict(list)
    for s in fills(counts, capacity)[0]:
        kinds[s[0]].append(s[1:])
    spark = docs.sparkSession
    schema = T._parse_datatype_string("length long, firsts array<long>, used array<long>, sequences array<long>, offsets array<long>")
    steps = spark.createDataFrame([(k, *map(list, zip(*v, strict=True))) for k, v in kinds.items()], schema)
    ranked = pieces.withColumn("rn", F.row_number().over(Window.partitionBy("length", "slot").orderBy("row")))
    ranked = ranked.join(base, ["length", "slot"]).withColumn("rank", F.col("rn") + F.col("base") - 1)
    placed = ranked.join(F.broadcast(steps), "length").withColumn("at", _step_of(F.col("rank"), F.col("firsts")))
    at = lambda c: F.get(c, F.col("at"))
    placed = placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") - at("firsts")).alias("nth"), at("used").alias("used"), at("sequences").alias("first"), at("offsets").alias("base"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth") % F.col("used")).alias("sequence_id"), (F.col("base") + F.floor(F.col("nth") / F.col("used")) * F.col("length")).alias("offset"))
