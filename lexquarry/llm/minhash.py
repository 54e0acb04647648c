"""Near-duplicate groups by one-permutation MinHash with optimal densification.

1. Every document's set of word shingles is hashed into BINS bins, of which each keeps its least value; an empty bin
   copies another one chosen by a hash of its own number (Shrivastava, 2017). Runs of bins make bands.
2. Documents with equal sets are one class from here on; its smallest id represents it.
3. A bucket holds the classes with one band in common; buckets with the same members count once. Each bucket gives a
   star: edges from its smallest member to every other, at most one a member. Edges are confirmed on the full sets.
4. Where the members beside a bucket's centre still belong to several components, their pairs are compared within
   blocks of bounded size (members and characters), on full sets, and only links that join two components leave the task. So no
   link between different texts is lost to the star's shape, and no group yields all its pairs.
5. Components of the links give the groups; all links stay distributed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import components, salted_join, settle, slices, texts
from ._words import SPACED, Words, mix, shingle_sets

BINS = 192
#: Members of a bucket that are compared at once, and the characters of their texts.
BLOCK, BLOCK_CHARS = 1024, 1 << 22
#: Below so many shingles a sketch says too little, and pairs go to the exact test at once.
SMALL = 400


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The densified bins of each non-empty set (rows of empty sets are zero)."""
    n = len(sets)
    sig, full = np.zeros(n * BINS, dtype=np.uint64), np.zeros(n * BINS, dtype=bool)
    u = np.concatenate(sets) if n else np.empty(0, np.uint64)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.repeat(np.arange(n) * BINS, size) + ((u >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(flat, prepend=-1))  # sets ascend, and with them the bins
    sig[flat[first]] = u[first]
    full[flat[first]] = True
    empty = np.flatnonzero(~full & np.repeat(size > 0, BINS))
    step = 0
    while len(empty):
        at = empty % BINS
        other = (mix(at.astype(np.uint64) * np.uint64(0x10001) + np.uint64(step * BINS * 0x10001 + 7)) % np.uint64(BINS)).astype(np.int64)
        source = empty - at + other
        ok = full[source]
        sig[empty[ok]] = sig[source[ok]]
        empty = empty[~ok]
        step += 1
    return sig.reshape(n, BINS)


def band_rows(threshold: float) -> int:
    """Bins in a band: as many as leave a pair at the threshold a chance of 1e-6 or less to share no band."""
    return max(r for r in range(1, 9) if r == 1 or (1 - threshold**r) ** (BINS // r) <= 1e-6)


def _bands(sig: np.ndarray, rows: int) -> np.ndarray:
    n = BINS // rows
    x = mix(sig[:, : n * rows]).reshape(len(sig), n, rows)
    h = np.zeros((len(sig), n), dtype=np.uint64)
    for j in range(rows):
        h = (h ^ x[:, :, j]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j)
    return mix(h + np.arange(n, dtype=np.uint64)[None, :] * np.uint64(0x632BE59BD9B4E019)).view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b|, on sorted distinct values."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    n = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * n >= percent * (len(a) + len(b) - n)


def _sketch(docs: DataFrame, k: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, chars=1 << 20):
            sets = list(shingle_sets(Words(b.column(1).to_pylist(), SPACED, True), k))
            n = np.array([len(s) for s in sets], dtype=np.int64)
            bands = _bands(sketches(sets), rows)
            d0 = np.array([int(np.bitwise_xor.reduce(mix(s))) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
            d1 = np.array([int(np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5)), dtype=np.uint64)) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
            chars = pa.array([len(t or "") for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), chars, pa.array(d0), pa.array(d1), pa.array([x.tolist() if c else [] for x, c in zip(bands, n.tolist(), strict=True)], pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "n_chars", "d0", "d1", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, n_chars long, d0 long, d1 long, bands array<long>")


def _confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are linked. Texts move once, by id, for both sides."""
    docs = docs.repartition("doc_id")
    one, two = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text")), docs.select(F.col("doc_id").alias("b"), F.col("text").alias("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, chars=1 << 20):
            left, right = (list(shingle_sets(Words(b.column(i).to_pylist(), SPACED, True), k)) for i in (2, 3))
            yield b.select(["a", "b"]).filter(pa.array([linked(x, y, percent) for x, y in zip(left, right, strict=True)], pa.bool_()))

    return salted_join(pairs, two, ["b"], ["a"]).join(one, "a").select("a", "b", "text", "other").mapInArrow(run, "a long, b long")


def _compare(k: int, percent: int):
    t = percent / 100
    least = t - 5 * math.sqrt(t * (1 - t) / BINS)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        one, two = key[1].as_py(), key[2].as_py()
        rep, block, label = rows.column("rep").to_pylist(), np.array(rows.column("block").to_pylist()), rows.column("label").to_pylist()
        sets = list(shingle_sets(Words(rows.column("text").to_pylist(), SPACED, True), k))
        size = np.array([len(s) for s in sets])
        low = sketches(sets).astype(np.uint8)
        parent = {x: x for x in label}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        found = []
        for i in range(len(rep)):
            if one != two and block[i] != one:
                continue
            js = np.arange(i + 1, len(rep)) if one == two else np.flatnonzero(block == two)
            near = 100 * np.minimum(size[js], size[i]) >= percent * np.maximum(size[js], size[i])
            js = js[near]
            est = (low[js] == low[i]).mean(axis=1) if len(js) else np.empty(0)
            ok = (est >= least) | (np.minimum(size[js], size[i]) < SMALL)
            for j in js[ok][np.argsort(-est[ok], kind="stable")].tolist():
                a, b = root(label[i]), root(label[j])
                if a != b and linked(sets[i], sets[j], percent):
                    parent[max(a, b)] = min(a, b)
                    found.append((rep[i], rep[j]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept) for every row of docs (doc_id, text).

    Words are runs of non-space characters after lower-casing A-Z; a set holds the distinct k-word shingles, or the whole
    sequence where it is shorter. Documents are linked where 100 * |a and b| >= percent * |a or b|; the component is the
    smallest id reachable, and only that document is kept. Null and empty texts have no shingles and no links. Rows with
    one id count as one document. A row without id has no links, no component and is kept. class_id is the smallest id with an equal set.
    """
    docs = texts(docs)
    rows = band_rows(percent / 100)
    sk = settle(_sketch(docs, k, rows))
    some = sk.where("n_shingles > 0 and doc_id is not null")
    classes = settle(some.groupBy("d0", "d1").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")))
    reps = some.join(classes.select("d0", "d1", F.col("class_id").alias("doc_id")), ["doc_id", "d0", "d1"], "left_semi")
    reps = reps.groupBy("doc_id", "d0", "d1").agg(F.any_value("bands").alias("bands"), F.any_value("n_chars").alias("n_chars"))  # repeated rows once
    in_bucket = reps.select(F.col("doc_id").alias("rep"), "n_chars", F.explode("bands").alias("bucket"))
    buckets = in_bucket.groupBy("bucket").agg(F.min("rep").alias("center"), F.count("*").alias("members"), F.bit_xor(F.xxhash64("rep")).alias("mark")).where("members > 1")
    buckets = settle(buckets.groupBy("center", "members", "mark").agg(F.min("bucket").alias("bucket")))
    held = salted_join(in_bucket, buckets.select("bucket", "center", "members"), ["bucket"], ["rep"], counts=buckets.select("bucket", F.col("members").alias("n")))
    members = settle(held.where("rep <> center").distinct())
    links = settle(_confirm(settle(members.select(F.col("rep").alias("a"), F.col("center").alias("b")).distinct()), docs, k, percent))
    groups = settle(components(links))

    # Only buckets with a member that isn't linked to the centre can hold several components.
    loose = members.where("members > 2").join(links.select(F.col("a").alias("rep"), F.col("b").alias("center")), ["rep", "center"], "left_anti").select("bucket").distinct()
    labelled = members.join(loose, "bucket", "left_semi").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = settle(labelled.select("bucket", "n_chars", "rep", F.coalesce("component", "rep").alias("label")))
    split = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.bit_xor(F.xxhash64("rep")).alias("mark"), F.count("*").alias("n"), F.sum("n_chars").alias("chars")).where("lo < hi")
    split = split.groupBy("lo", "hi", "mark", "n", "chars").agg(F.min("bucket").alias("bucket"))  # the same members under another centre
    # Members of one component needn't be compared: those of a bucket's largest one meet all others, and only the others meet each other.
    sizes = labelled.groupBy("bucket", "label").agg(F.count("*").alias("c"), F.sum("n_chars").alias("cs"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("c", "label", "cs")).alias("m")).select("bucket", F.col("m.label").alias("main"), F.col("m.c").alias("c"), F.col("m.cs").alias("cs"))
    many = lambda n, chars: F.greatest(F.ceil(n / BLOCK), F.ceil(chars / BLOCK_CHARS), F.lit(1)).cast("int")
    split = split.join(main, "bucket").select("bucket", "main", many(F.col("c"), F.col("cs")).alias("h"), many(F.col("n") - F.col("c"), F.col("chars") - F.col("cs")).alias("l"))
    rest = salted_join(labelled.drop("n_chars"), split, ["bucket"], ["rep"]).withColumn("in_main", F.col("label") == F.col("main"))
    rest = rest.withColumn("block", F.when(F.col("in_main"), F.pmod(F.xxhash64("rep"), F.col("h"))).otherwise(F.col("h") + F.pmod(F.xxhash64("rep"), F.col("l"))).cast("int"))
    rest = rest.withColumn("peer", F.explode(F.sequence(F.when(F.col("in_main"), F.col("h")).otherwise(0), F.col("h") + F.col("l") - 1)))
    rest = settle(rest.select("bucket", F.least("block", "peer").alias("i"), F.greatest("block", "peer").alias("j"), "block", "rep", "label"))
    with_text = salted_join(rest, docs.select(F.col("doc_id").alias("rep"), "text"), ["rep"], ["bucket", "i", "j"])
    more = settle(with_text.groupBy("bucket", "i", "j").applyInArrow(_compare(k, percent), "a long, b long"))
    if not more.isEmpty():
        groups = settle(components(links.union(more)))

    classes = classes.join(groups.withColumnRenamed("node", "class_id"), "class_id", "left")
    classes = settle(classes.select("d0", "d1", "n", "class_id", F.coalesce("component", "class_id").alias("component_id")))
    out = salted_join(some.select("doc_id", "n_shingles", "d0", "d1"), classes.drop("n"), ["d0", "d1"], ["doc_id"], counts=classes.select("d0", "d1", "n")).select("doc_id", "n_shingles", "class_id", "component_id")
    bare = sk.where("not (n_shingles > 0 and doc_id is not null)")  # without shingles or id: in no join
    own = F.when(F.col("n_shingles") > 0, F.lit(None).cast("long")).otherwise(F.col("doc_id"))
    bare = bare.select("doc_id", "n_shingles", own.alias("class_id"), F.col("doc_id").alias("component_id"))
    return out.unionByName(bare).select("doc_id", "n_shingles", "class_id", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
