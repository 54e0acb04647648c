"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

1. Equal vectors are one class. Each class gets its unit vector in int8 (one scale a vector) and the length of what the
   rounding left, e. For unit vectors u, v with such approximations, |u.v - u'.v'| <= e_u + e_v + e_u * e_v.
2. Classes are dealt into blocks by their nearest pivot. A block keeps its least and greatest angle to every pivot; two blocks whose
   ranges lie further apart than the threshold's angle, for any pivot, can't hold a link and never meet.
3. Every other pair of blocks is one task: products of int8 tiles decide almost all pairs, those within the bound of the threshold are
   computed anew in double precision. No pair leaves a task: it gives each vector's number of links, and a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import components, salted_join, settle

#: Vectors of a block at most, blocks that a table of some size has at least, and vectors of a tile of products.
BLOCK, BLOCKS, TILE = 8192, 8, 1024
#: Pivots at most. They are vectors of the table, least by a hash of their values; any choice gives right results.
PIVOTS = 64
#: Pairs computed in double precision at once.
EXACT = 1 << 16
#: What float and double rounding may add to products of unit vectors.
SLACK = 1e-6


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, int8 codes, scales and bounds of the rows of x: u = scale * codes + a rest no longer than the bound."""
    big = np.abs(x).max(axis=1, keepdims=True)
    u = x / big
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    scale = np.abs(u).max(axis=1) / 127
    codes = np.rint(u / scale[:, None]).astype(np.int8)
    rest = u - codes * scale[:, None]
    return u, codes, scale, np.sqrt((rest * rest).sum(axis=1)) * (1 + 1e-9) + 1e-12


class Forest:
    """Connected components of vertices 0 to n - 1, joined by arrays of edges; `at` is each vertex's smallest known one."""

    def __init__(self, n: int) -> None:
        self.at = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.at[a], self.at[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.at, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.at[self.at]
                if (up == self.at).all():
                    break
                self.at = up


def tile_links(one: tuple, two: tuple, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(i, j, recomputed) of each tile: the places in `one` and `two` (units, codes, scales, bounds) whose cosine reaches the threshold."""
    width = one[1].shape[1]
    for p in range(0, len(one[1]), TILE):
        for q in range(0, len(two[1]), TILE):
            a, b = one[1][p : p + TILE].astype(np.float32), two[1][q : q + TILE].astype(np.float32)
            # Whole numbers below 2**24 are exact in float32: 1024 products of int8 numbers at a time.
            product = a[:, :1024] @ b[:, :1024].T
            for k in range(1024, width, 1024):
                product = product.astype(np.float64) + a[:, k : k + 1024] @ b[:, k : k + 1024].T
            sa, sb, ea, eb = one[2][p : p + TILE], two[2][q : q + TILE], one[3][p : p + TILE], two[3][q : q + TILE]
            product *= sb[None, :].astype(np.float32)
            worst = eb.max(initial=0)
            i, j = np.nonzero(product >= ((threshold - ea - worst - ea * worst - SLACK) / sa)[:, None].astype(np.float32))
            near = product[i, j].astype(np.float64) * sa[i]
            bound = ea[i] + eb[j] + ea[i] * eb[j] + SLACK
            sure = near - bound >= threshold
            again = np.flatnonzero(~sure & (near + bound >= threshold))
            for k in range(0, len(again), EXACT):
                c = again[k : k + EXACT]
                sure[c] = (one[0][p + i[c]] * two[0][q + j[c]]).sum(axis=1) >= threshold
            yield p + i[sure], q + j[sure], len(again)


def _matrices(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the lists of each length."""
    begin = lists.offsets.to_numpy()
    flat, size = lists.values.to_numpy(zero_copy_only=False), np.diff(begin)
    for w in np.unique(size):
        at = np.flatnonzero(size == w)
        yield at, flat[begin[at][:, None] + np.arange(w)]


def _codes(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(d0, d1, rep, copies, vec: array<double>) with the unit vector's bytes as vec, int8 codes, scale, bound, and its cell: the nearest pivot, or
    one of as many cells for all other lengths; angles are those to the pivots."""
    n = len(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 1024):
                b = big.slice(lo, 1024)
                for at, x in _matrices(b.column(4)):
                    u, codes, scale, bound = quantised(x)
                    main = x.shape[1] == pivots.shape[1]
                    angle = np.arccos(np.clip(u @ pivots.T, -1, 1)) if main else np.zeros((len(at), n))
                    cell = angle.argmin(axis=1) if main else np.full(len(at), n + x.shape[1] % n)
                    own = b.take(pa.array(at)).columns[:4]
                    found = [pa.array([r.tobytes() for r in u], pa.binary()), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(scale), pa.array(bound), pa.array(cell, pa.int32()), pa.array(list(angle.astype(np.float32)), pa.list_(pa.float32()))]
                    yield pa.RecordBatch.from_arrays([*own, *found], names=["d0", "d1", "rep", "copies", "vec", "codes", "scale", "bound", "cell", "angles"])

    return vectors.mapInArrow(run, "d0 long, d1 long, rep long, copies long, vec binary, codes binary, scale double, bound double, cell int, angles array<float>")


def _compare(threshold: float):
    """The links of two blocks i <= j: one row a vector that has some, with their number and the smallest id that it reaches by them."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = key[0].as_py(), key[1].as_py()
        block, ids, copies, width, scale, bound = (rows.column(c).to_numpy() for c in ("block", "rep", "copies", "width", "scale", "bound"))
        links, forest, again = np.zeros(len(ids), np.int64), Forest(len(ids)), np.zeros(len(ids), np.int64)
        for w in np.unique(width):
            mine = np.flatnonzero((block == i) & (width == w))
            theirs = mine if i == j else np.flatnonzero((block == j) & (width == w))
            raw = lambda c, t, at: np.frombuffer(b"".join(rows.column(c).take(pa.array(at)).to_pylist()), t).reshape(len(at), w)  # noqa: E731, B023
            side = lambda at: (raw("vec", np.float64, at), raw("codes", np.int8, at), scale[at], bound[at])  # noqa: E731, B023
            for a, b, n in tile_links(side(mine), side(theirs), threshold):
                a, b = mine[a], theirs[b]
                other = ids[a] != ids[b]
                a, b = a[other], b[other]
                links += np.bincount(a, copies[b], len(ids)).astype(np.int64)
                if i != j:
                    links += np.bincount(b, copies[a], len(ids)).astype(np.int64)
                forest.join(a, b)
                again[mine[:1]] += n
        some = np.flatnonzero((links > 0) | (again > 0))
        low = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(low, forest.at, ids)
        own = [rows.column(c).take(pa.array(some)) for c in ("d0", "d1", "rep")]
        return pa.table([*own, pa.array(links[some]), pa.array(low[forest.at[some]]), pa.array(again[some])], names=["d0", "d1", "rep", "n_links", "other", "recomputed"])

    return run


def class_links(vectors: DataFrame, threshold: float, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(d0, d1, rep, n_links, other, recomputed) for classes (d0, d1, rep, copies, vec: array<double>) that have links, once for each pair of blocks
    that holds some. `other` is the smallest rep that a class reaches by those links; `recomputed` adds up to the pairs computed in double precision."""
    sizes = vectors.groupBy(F.size("vec").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(1).collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "d0 long, d1 long, rep long, n_links long, other long, recomputed long")
    width, n = sizes[0]
    block = min(block, max(TILE, -(-n // BLOCKS)))
    sample = vectors.where(F.size("vec") == width).orderBy("d0", "d1").limit(max(1, min(pivots, n // block))).select("vec").collect()
    coded = settle(_codes(vectors.select("d0", "d1", "rep", "copies", "vec"), quantised(np.array([r[0] for r in sample], np.float64))[0]))
    n = len(sample)
    begin, cut = 0, []
    for cell, size in coded.groupBy("cell").agg(F.count("*").alias("n")).orderBy("cell").collect():  # at most twice as many cells as pivots
        cut.append((cell, begin, -(-size // block)))
        begin += cut[-1][2]
    find = lambda k: F.element_at(F.create_map(*[F.lit(x) for c in cut for x in (c[0], c[k])]), F.col("cell"))
    coded = coded.withColumn("block", (find(1) + F.pmod(F.xxhash64("d0", "d1"), find(2))).cast("int"))
    each = lambda f: F.array(*[f(F.col("angles")[k]) for k in range(n)])
    reach = settle(coded.groupBy("block", "cell").agg(each(F.min).alias("lo"), each(F.max).alias("hi")))
    ours = reach.select(F.col("block").alias("i"), F.col("cell").alias("c1"), "lo", "hi", F.explode(F.sequence("block", F.lit(begin - 1))).alias("j"))
    theirs = reach.select(F.col("block").alias("j"), F.col("cell").alias("c2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    limit = math.acos(threshold) + 1e-5
    apart = F.exists(F.arrays_zip("lo", "hi", "lo2", "hi2"), lambda t: (t["lo2"] - t["hi"] > limit) | (t["lo"] - t["hi2"] > limit))
    pairs = ours.join(theirs, "j").where(~apart & ((F.col("c1") == F.col("c2")) | (F.greatest("c1", "c2") < n)))
    roles = settle(pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")))
    dealt = coded.select("block", "d0", "d1", "rep", "copies", "vec", "codes", F.octet_length("codes").alias("width"), "scale", "bound").join(roles, "block")
    return dealt.groupBy("i", "j").applyInArrow(_compare(threshold), "d0 long, d1 long, rep long, n_links long, other long, recomputed long")


def near_embeddings(rows: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: the number of other vectors whose cosine with it is `threshold` (above 0) or more, and
    the smallest id that such links reach.

    Vectors that are null, empty, zero or hold null or non-finite numbers, and rows without id (kept, without component), have no links.
    Vectors of different lengths have none with each other. A repeated row counts once and gives a row each time. Different
    vectors under one id have links of their own and one component. Other columns are ignored.
    """
    vec = rows[vec_col].cast("array<double>")
    rows = rows.select(rows[id_col].cast("long").alias("vec_id"), F.transform(vec, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)).alias("vec"))
    fine = (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())
    marked = rows.select("vec_id", "fine", "vec", F.xxhash64("vec").alias("d0"), F.xxhash64(F.lit(1), "vec").alias("d1"))
    good = marked.where("fine")
    ids = settle(good.select("vec_id", "d0", "d1").distinct())
    classes = settle(ids.groupBy("d0", "d1").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    first = good.join(classes.withColumn("vec_id", F.col("rep")), ["vec_id", "d0", "d1"]).dropDuplicates(["d0", "d1"])
    links = settle(class_links(first.select("d0", "d1", "rep", "copies", "vec"), threshold, block, pivots))
    several = ids.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id")
    one_id = ids.join(several, "vec_id").join(classes, ["d0", "d1"]).select(F.col("rep").alias("a"), F.col("vec_id").alias("b"))
    groups = components(links.select(F.col("rep").alias("a"), F.col("other").alias("b")).union(one_id))
    counts = links.groupBy("d0", "d1").agg(F.sum("n_links").alias("n"))
    classes = classes.join(counts, ["d0", "d1"], "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    classes = settle(classes.select("d0", "d1", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = salted_join(good.select("vec_id", "d0", "d1"), classes.drop("copies"), ["d0", "d1"], ["vec_id"], counts=classes.select("d0", "d1", F.col("copies").alias("n"))).select("vec_id", "n_links", "component_id")
    bare = marked.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(bare).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
