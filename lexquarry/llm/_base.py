"""Shared pieces of the corpus operators: input shape, checkpoints, batch slicing and connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import let

#: A key is hot from this share of a table's rows on, so that at most as many keys are hot as the share's inverse says.
HOT_SHARE = 1 / 200

#: Edges that one task takes through the rounds of components(): dealt over all partitions, so few are hundreds of files a round.
FEW_EDGES = 50_000
#: Tasks that read the keys with over 1000 rows, once they are counted.
HOT_TASKS = 8

#: Characters of text handled at once by a Python batch; a longer text is a batch of its own.
SLICE_CHARS = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, so that no other column can clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def settle(df: DataFrame) -> DataFrame:
    """Cuts the lineage with checkpoint(), in the folder that `spark.checkpoint.dir` names; a temporary one only where that is unset."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="lexquarry-"))
    return df.checkpoint(eager=True)


def running(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array, `combine` over all elements before it, from `zero` on (of the elements' type, and neutral).

    Appending to an array copies it, so a plain pass is quadratic. Here chunks of about the root of the length are passed one
    by one, then the chunks' totals: n to the power of 1.5 copies of a reference.
    """

    def scan(a: Column, start: Column) -> Column:
        empty = F.slice(F.array(zero), F.lit(1), F.lit(0))
        step = lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(a, F.struct(start.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    def chunked(a: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(a))).cast("int")
        cut = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / w).cast("int")), lambda i: F.slice(a, i * w + 1, w))
        return let(let(width, cut), lambda chunks: F.flatten(F.zip_with(chunks, scan(F.transform(chunks, lambda c: F.aggregate(c, zero, lambda x, y: combine(x, y))), zero), lambda c, at: scan(c, at))))

    return let(values, lambda a: F.when(F.size(a) == 0, F.slice(F.array(zero), F.lit(1), F.lit(0))).otherwise(chunked(a)))


def hot_keys(big: DataFrame, on: list[str], counts: DataFrame | None = None) -> DataFrame:
    """(on, salts) of the keys with over 1000 rows that hold HOT_SHARE or more of all such keys' rows: at most 200. `counts` (on, n),
    if the rows are counted already."""
    counts = big.groupBy(*on).agg(F.count("*").alias("n")) if counts is None else counts.select(*on, "n")
    counts = settle(counts.where("n > 1000")).coalesce(HOT_TASKS)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return counts.where(F.col("n") >= max(1000.0, total * HOT_SHARE)).select(*on, F.ceil(F.col("n") / F.lit(max(500.0, total * HOT_SHARE / 4))).cast("int").alias("salts"))


def salted_join(big: DataFrame, small: DataFrame, on: list[str], spread: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """big joined with small on keys that are not null. The rows of a hot key of `big` are dealt over several tasks by a hash of
    `spread`, and the key's rows of `small`, of which there are few, go to each of them. `how` is inner or left."""
    hot = hot_keys(big, on, counts)
    if hot.isEmpty():
        return big.join(small, on, how)
    hot = F.broadcast(hot)  # HOT_SHARE bounds its rows
    cold = big.join(hot.select(*on), on, "left_anti").join(small, on, how)
    dealt = big.join(hot, on).withColumn("_salt", F.pmod(F.xxhash64(*spread, F.lit("salt")), F.col("salts")).cast("int")).drop("salts")
    copied = small.join(hot, on).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return cold.unionByName(dealt.join(copied, [*on, "_salt"], how).select(cold.columns))


def slices(batches: Iterator[pa.RecordBatch], text_col: str = "text", chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each has about `chars` bytes of text at most, or one row."""
    for b in batches:
        col = b.column(b.schema.get_field_index(text_col))
        size = 0
        lo = 0
        lengths = pc.binary_length(col).to_pylist()
        for i, n in enumerate(lengths):
            n = n or 0
            if i > lo and size + n > chars:
                yield b.slice(lo, i - lo)
                lo, size = i, 0
            size += n
        if len(lengths) > lo:
            yield b.slice(lo)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str, text_col: str = "text", chars: int = SLICE_CHARS) -> DataFrame:
    """mapInArrow with `f` on slices of bounded text; `f` returns columns by name, as arrays or lists."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, chars):
            out = f(b)
            yield pa.RecordBatch.from_arrays([pa.array(out[x.name], type=x.type) if not isinstance(out[x.name], pa.Array) else out[x.name].cast(x.type) for x in target], schema=target)

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of `edges` (a, b: long); the component is its smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014), both as grouped minima and equi-joins, until
    every edge leads to a smallest node. Edges stay distributed, unless they are FEW_EDGES at most: those lie in one partition, which no step
    deals out. Only the edges' count and two digests of 64 bits reach the driver.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = settle(e)
    few = e.count() <= FEW_EDGES
    together, beside = (lambda df: df.coalesce(1), F.broadcast) if few else (lambda df: df, lambda df: df)
    e, seen = together(e), None
    for _ in range(max_rounds):
        both = together(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        low = both.groupBy("a").agg(F.min("b").alias("m0")).select("a", F.least("a", "m0").alias("m"))
        large = both.join(beside(low), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(beside(least), "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        e = together(settle(together(small).distinct()))
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return together(e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))))
