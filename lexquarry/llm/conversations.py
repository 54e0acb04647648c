"""The prefix tree of conversations, built as a Patricia tree over sorted conversations.

1. Every turn becomes a digest of 16 bytes, every conversation the string of its turns' digests; texts don't move. Equal
   conversations are one sequence from here on.
2. The sequences are sorted by ranges. The only points of the compressed tree are the ends of sequences and the places
   where two neighbours of the sorted order part, so a task needs its own rows and two numbers: how many turns its first
   row shares with the row before, and its last row with the row after.
3. Each task builds the compressed tree of its range with a stack, sums it up from below, and expands the edges: nodes
   inside an edge have the members of its lower end, and their sums are suffix sums along the edge.
4. Only nodes on the paths that a range shares with its neighbours have parts in several tasks. All figures are kept so
   that parts add up (minima and sums; what is counted once a node belongs to the first range that has the node).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ._base import salted_join, settle

WIDTH = 16  # bytes of a turn's digest
#: Turns of a range that one task turns into a tree.
RANGE_TURNS = 1 << 16
#: Ids of a list of ends that are joined to one row before the lists are hashed.
CHUNK_IDS = 4096

_NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, counted long, once long, ends string, "
    "place string, above string, shared boolean"
)


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (digest, chars)) of every conversation, in the order of its turns (null first; equal turns by digest)."""
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    listed = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "chars"))).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda x: F.struct(x["digest"].alias("digest"), x["chars"].alias("chars"))).alias("turns"))


def rebuilt(own: DataFrame, base: Column, kept: Column, most: int) -> DataFrame:
    """Conversations whose first `kept` turns (at most `most`) are those of conversation `base`, if there is one; `base` and `kept` are columns over `own`."""
    heads = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    with_base = own.select("conv_id", "turns", base.cast("long").alias("base"), kept.cast("int").alias("kept")).join(heads, "base", "left")
    none = F.slice("turns", F.lit(1), F.lit(0))
    return with_base.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("kept")), F.slice("turns", F.col("kept") + 1, F.size("turns"))).alias("turns"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (sid, conv_id) to rows of up to CHUNK_IDS ids of one sid."""
    sid, ids = None, []
    out: list[tuple[str, int, str]] = []

    def done(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["sid", "first", "ids"])

    for b in batches:
        for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if ids and (s != sid or len(ids) == CHUNK_IDS):
                out.append((sid, ids[0], ",".join(map(str, ids))))
                ids = []
            sid = s
            ids.append(c)
        if len(out) >= 256:
            yield done(out)
            out = []
    if ids:
        out.append((sid, ids[0], ",".join(map(str, ids))))
    if out:
        yield done(out)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (sid, first, ids) to (sid, ends): the lists are read piece by piece, so the longest one needs no memory."""
    sid, state = None, None
    done: list[tuple[str, str]] = []
    for b in batches:
        for s, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if s == sid:
                state.update(b"," + ids.encode())
                continue
            if sid is not None:
                done.append((sid, state.hexdigest()))
            sid, state = s, hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done]), pa.array([y for _, y in done])], names=["sid", "ends"])
            done = []
    if sid is not None:
        yield pa.RecordBatch.from_arrays([pa.array([sid]), pa.array([state.hexdigest()])], names=["sid", "ends"])


def distinct(seqs: DataFrame) -> DataFrame:
    """(key, chars, rep, weight, ends) of each distinct sequence: its digests, its turns' lengths, its smallest conversation, their number and the hash of their ids."""
    rows = seqs.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("key"), F.col("turns.chars").alias("chars")).withColumn("sid", F.md5("key"))
    rows = settle(rows)
    groups = settle(rows.groupBy("sid").agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight")))
    several = salted_join(rows.select("sid", "conv_id"), groups.where("weight > 1").select("sid"), ["sid"], ["conv_id"], counts=groups.select("sid", F.col("weight").alias("n")))
    lists = several.repartitionByRange("sid", "conv_id").sortWithinPartitions("sid", "conv_id").mapInArrow(_chunks, "sid string, first long, ids string")
    hashes = lists.repartition("sid").sortWithinPartitions("sid", "first").mapInArrow(_hashes, "sid string, ends string")
    groups = groups.join(hashes, "sid", "left").select("sid", F.col("rep").alias("conv_id"), "weight", F.coalesce("ends", F.sha2(F.col("rep").cast("string").cast("binary"), 256)).alias("ends"))
    return rows.join(groups, ["sid", "conv_id"]).select("key", "chars", F.col("conv_id").alias("rep"), "weight", "ends")


def shared(a: bytes, b: bytes) -> int:
    """Turns that two sequences have in common from their beginnings."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    x = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(x.argmax()) // WIDTH


def subtree(rows: list[tuple[bytes, np.ndarray, int, int, str]], before: int, after: int) -> pa.RecordBatch:
    """All nodes of the sorted rows (key, chars, rep, weight, ends), as far as this range knows them.

    before: turns that the first row shares with the row before the range (-1: there is none); after: the last row with the row after it.
    counted: members times code points, summed over the subtree. once: code points of the subtree's nodes that no range before has.
    """
    depth, up, row, low, members, kids, leaves, counted, once, ends = ([] for _ in range(10))

    def point(d: int, i: int) -> int:
        for column, x in ((depth, d), (up, -1), (row, i), (low, rows[i][2]), (members, 0), (kids, 0), (leaves, 0), (counted, 0), (once, 0), (ends, None)):
            column.append(x)
        return len(depth) - 1

    first = max(before, 0)
    reach = len(rows[0][0]) // WIDTH  # turns that the row has in common with the first one
    limit: list[int] = []  # of each point: as deep as its path is on the first row
    total = [np.concatenate(([0], np.cumsum(r[1]))) for r in rows]
    stack = [point(0, 0)]
    limit.append(0)

    def pop(to: int) -> None:
        """Closes the points below depth `to`, and puts one there if there is none."""
        while depth[stack[-1]] > to:
            v = stack.pop()
            if depth[stack[-1]] < to:
                limit.append(min(limit[v], to))
                stack.append(point(to, row[v]))
            w = stack[-1]
            up[v] = w
            c = total[row[v]]
            own = max(depth[w], min(limit[v], first))  # what the edge adds that no range before has
            low[w] = min(low[w], low[v])
            members[w] += members[v]
            leaves[w] += leaves[v]
            kids[w] += depth[w] + 1 > min(limit[v], first)
            counted[w] += counted[v] + members[v] * int(c[depth[v]] - c[depth[w]])
            once[w] += once[v] + max(0, int(c[depth[v]] - c[min(own, depth[v])]))

    for i, (key, _, rep, weight, hashed) in enumerate(rows):
        n = len(key) // WIDTH
        if i:
            d = shared(rows[i - 1][0], key)
            reach = min(reach, d)
            pop(d)
        if n > depth[stack[-1]]:
            limit.append(min(reach, n))
            stack.append(point(n, i))
        v = stack[-1]
        members[v] += weight
        low[v] = min(low[v], rep)
        ends[v] = hashed
        follows = shared(key, rows[i + 1][0]) if i + 1 < len(rows) else after
        leaves[v] += follows < n
    right = set(stack)
    pop(0)

    # Expansion: one entry a node of the whole tree, edge by edge.
    d, u = np.array(depth), np.array(up)
    top = np.where(u >= 0, d[u], -1)
    size = d - top
    v = np.repeat(np.arange(len(d)), size)
    at = np.arange(len(v)) - np.repeat(np.cumsum(size) - size, size) + top[v] + 1
    lim = np.minimum(np.array(limit), first)
    if after >= 0:
        lim = np.maximum(lim, np.where(np.isin(np.arange(len(d)), list(right)), np.minimum(d, after), 0))
    left = np.minimum(np.array(limit), first)
    end = at == d[v]
    flat = np.concatenate([*total, [0]])
    base = np.cumsum([0, *(len(t) for t in total)])[np.array(row)]
    below = flat[base[v] + d[v]] - flat[base[v] + at]  # the edge's suffix sum
    own_chars = np.where(at > 0, flat[base[v] + at] - flat[base[v] + np.maximum(at - 1, 0)], 0)
    m, w = np.array(members)[v], np.array(once)[v]
    had = before >= 0
    seen = np.where(had, left[v], -1)  # nodes up to this depth are those of a range before
    new_below = flat[base[v] + d[v]] - flat[base[v] + np.minimum(np.maximum(at, seen), d[v])]
    own_once = np.where(at > seen, own_chars, 0)
    is_shared = (at <= lim[v]) | (at == 0)
    hanging = ~is_shared & (at - 1 <= np.where(at - 1 > top[v], lim[v], lim[np.maximum(u, 0)][v]))
    keys = [rows[r][0] for r in row]
    place = [hashlib.md5(keys[x][: k * WIDTH]).hexdigest() if s else None for x, k, s in zip(v.tolist(), at.tolist(), is_shared.tolist(), strict=True)]
    above = [hashlib.md5(keys[x][: (k - 1) * WIDTH]).hexdigest() if k and (s or h) else None for x, k, s, h in zip(v.tolist(), at.tolist(), is_shared.tolist(), hanging.tolist(), strict=True)]
    lows = np.array(low)
    parent = np.where(at - 1 > top[v], lows[v], lows[np.maximum(u, 0)][v])
    child = np.where(at + 1 > seen, 1, 0)  # of a node inside an edge
    columns = {
        "conv_id": lows[v], "depth": at, "parent_conv_id": pa.array(parent, mask=is_shared | hanging), "n_convs": m, "n_children": np.where(end, np.array(kids)[v], child), "n_leaves": np.array(leaves)[v],
        "counted": np.array(counted)[v] + m * (below + own_chars), "once": w + new_below + own_once, "ends": pa.array([ends[x] if e else None for x, e in zip(v.tolist(), end.tolist(), strict=True)], pa.string()),
        "place": pa.array(place, pa.string()), "above": pa.array(above, pa.string()), "shared": is_shared,
    }
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x.astype(np.int64) if x.dtype != bool else x) for x in columns.values()], names=list(columns))


def prefix_tree(seqs: DataFrame, range_turns: int = RANGE_TURNS) -> DataFrame:
    """The nodes of the prefix tree of (conv_id, turns: array of (digest, chars)): one row for each distinct sequence of first turns.

    conv_id is the smallest member; parent_conv_id that of the node above (null at the root). n_convs counts members,
    n_children and n_leaves nodes; saved_tokens is the sum of (n_convs - 1) times the code points of the last turn over the
    subtree. ends_sha256 hashes the ids of the conversations that end at the node. Conversations without turns end at the root. No
    conversations, no nodes. A conversation's digests (16 bytes a turn) have to fit into a record.
    """
    rows = settle(distinct(seqs))
    turns = rows.agg(F.coalesce(F.sum(F.size("chars")), F.lit(0)) + F.count("*")).first()[0]
    parts = max(1, min(-(-turns // range_turns), 4096 + turns // (64 * range_turns)))
    rows = settle(rows.repartitionByRange(parts, "key").sortWithinPartitions("key")).withColumn("part", F.spark_partition_id())
    order = Window.orderBy("part")  # as many rows as there are ranges
    edges = rows.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    edges = edges.select("part", "first", "last", F.lag("last").over(order).alias("earlier"), F.lead("first").over(order).alias("later"))
    common = F.pandas_udf(lambda a, b: a.combine(b, lambda x, y: -1 if x is None or y is None else shared(bytes(x), bytes(y))), LongType())
    known = {r[0]: (r[1], r[2]) for r in edges.select("part", common("earlier", "first"), common("last", "later")).collect()}  # numbers only

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, part = [], None
        for b in batches:
            part = b.column(5)[0].as_py() if b.num_rows else part
            got += zip(b.column(0).to_pylist(), (np.array(x, np.int64) for x in b.column(1).to_pylist()), *(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)
        if got:
            whole = subtree(got, *known[part])
            for lo in range(0, whole.num_rows, 1 << 15):
                yield whole.slice(lo, 1 << 15)

    nodes = settle(rows.mapInArrow(build, _NODES))
    both = nodes.where("shared").groupBy("depth", "place").agg(
        F.min("conv_id").alias("conv_id"), F.max("above").alias("above"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "counted", "once")], F.max("ends").alias("ends")
    )
    both = settle(both)
    kept = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "counted", "once", "ends"]
    hang = nodes.where("not shared and above is not null").select(*kept, "above").unionByName(both.where("depth > 0").select(*kept, "above"))
    tops = both.select(F.col("place").alias("above"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    hung = salted_join(hang, tops, ["above", "depth"], ["conv_id"])
    root = both.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    plain = nodes.where("not shared and above is null")
    out = plain.select(*kept, "parent_conv_id").unionByName(hung.select(*kept, "parent_conv_id")).unionByName(root.select(*kept, "parent_conv_id"))
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("counted") - F.col("once")).alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    )


def conversation_tree(turns: DataFrame) -> DataFrame:
    """The prefix tree of the conversations (conv_id, turn, role, text) rebuilt on the heads of every hundredth one.

    Conversation c takes its first h = crc32(decimal c) % 6 turns from conversation c - c % 100 (all it has, if fewer; none if there is
    no such one) and keeps its own turns after its first h. Turns go by number, null first; those of one number by digest, repeated rows
    are turns of their own. Null roles and texts are empty. Rows without conv_id belong to no conversation. Other columns are ignored.
    """
    c = F.col("conv_id")
    return prefix_tree(rebuilt(sequences(turns), c - c % 100, F.crc32(c.cast("string").cast("binary")) % 6, 5))
