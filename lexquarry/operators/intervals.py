"""Directories as intervals: every entry has a number in depth-first order, a directory also the last one below it.

One parallel sort numbers the entries and the ends of directories; what lies below a directory is a range of numbers, and sums
over it are differences of running sums. Only one row a range of the sort (counts and sums) is brought together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .corpus import hold

#: Sorts after every name, so that a directory's end follows all that is below it.
_AFTER = "\U0010ffff"


def running_sums(rows: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """rows with each of `values` summed up to and including the row, over the whole table in the given order, which has no ties."""
    held = hold(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    ranges = held.groupBy("_part").agg(*[F.sum(v).alias(v) for v in values])
    offsets = ranges.select("_part", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_{v}") for v in values])
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = held.withColumns({v: F.sum(v).over(inside) for v in values}).join(offsets, "_part")
    return summed.withColumns({v: F.col(v) + F.col(f"_{v}") for v in values}).drop("_part", "_at", *[f"_{v}" for v in values])


def intervals(entries: DataFrame) -> DataFrame:
    """(path, entry_type, first, last, entries_below, files_below, bytes_below) of all entries: numbers from 1 in depth-first order, siblings by name, the
    number of the last entry below (its own for all but directories), and what a directory holds at any depth."""
    steps = F.when(F.col("path") == ".", F.array().cast("array<string>")).otherwise(F.split("path", "/"))
    is_file = F.col("entry_type") == "file"
    own = entries.select("path", "entry_type", steps.alias("steps"), F.lit(0).alias("is_end"), F.lit(1).cast("long").alias("n"), is_file.cast("long").alias("files"), F.when(is_file, F.coalesce("size_bytes", F.lit(0))).otherwise(0).cast("long").alias("bytes"))
    ends = own.where("entry_type = 'directory'").select("path", "entry_type", F.concat("steps", F.array(F.lit(_AFTER))).alias("steps"), F.lit(1).alias("is_end"), *[F.lit(0).cast("long").alias(x) for x in ("n", "files", "bytes")])
    at = running_sums(own.unionByName(ends), ["steps", "is_end"], ["n", "files", "bytes"])
    ended = at.where("is_end = 1").select("path", *[F.col(x).alias(f"{x}_end") for x in ("n", "files", "bytes")])
    below = lambda x: F.coalesce(F.col(f"{x}_end") - F.col(x), F.lit(0))
    out = at.where("is_end = 0").join(ended, "path", "left")
    return out.select("path", "entry_type", F.col("n").alias("first"), F.coalesce("n_end", "n").alias("last"), below("n").alias("entries_below"), below("files").alias("files_below"), below("bytes").alias("bytes_below"))


def below(numbered: DataFrame, path: str) -> DataFrame:
    """The entries below a directory and itself, by their numbers; none if there is no such entry."""
    at = numbered.where(F.col("path") == path).select("first", "last").first()
    return numbered.where(F.col("first").between(*at)) if at else numbered.limit(0)
