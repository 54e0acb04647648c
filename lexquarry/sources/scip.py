"""Code-intelligence graphs exported as JSON: definitions and references as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "documents array<struct<relative_path: string, language: string, symbols: array<string>, occurrences: array<struct<symbol: string, symbol_roles: int, range: array<int>>>>>"


def _flat(graphs: DataFrame) -> DataFrame:
    docs = graphs.select("ordinal", F.posexplode("documents").alias("d", "doc"))
    occ = docs.select("ordinal", "d", "doc.relative_path", "doc.language", F.posexplode("doc.occurrences").alias("o", "occ"))
    return occ.select(
        F.coalesce("occ.symbol", F.lit("")).alias("symbol"), F.coalesce("relative_path", F.lit("")).alias("relative_path"), F.coalesce("language", F.lit("")).alias("language"),
        F.coalesce("occ.symbol_roles", F.lit(0)).alias("roles"), F.coalesce("occ.range", F.array(*[F.lit(0)] * 4)).alias("range"), F.struct("ordinal", "d", "o").alias("ordinal"),
    )


def occurrences(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, relative_path, language, roles, range, ordinal) of all documents of a JSON file, in file order. A file is read by one task; larger graphs come in parts (occurrences_of)."""
    return _flat(spark.read.schema(_SCHEMA).json(path, multiLine=True).select(F.lit(0).cast("long").alias("ordinal"), "documents"))


def occurrences_of(parts: DataFrame) -> DataFrame:
    """The same of a graph that comes in parts: rows (ordinal: the part's place, value: its JSON). Parts that aren't JSON have no occurrences."""
    return _flat(parts.select("ordinal", F.from_json("value", _SCHEMA).alias("g")).select("ordinal", "g.documents"))


def definitions(occ: DataFrame) -> DataFrame:
    """(symbol, relative_path, range) of defining occurrences; the last of a symbol counts."""
    return occ.where(F.col("roles").bitwiseAND(1) == 1).groupBy("symbol").agg(F.max_by(F.struct("relative_path", "range"), "ordinal").alias("x")).select("symbol", "x.relative_path", "x.range")


def references(occ: DataFrame) -> DataFrame:
    """(symbol, relative_path, range, ordinal) of all other occurrences."""
    return occ.where(F.col("roles").bitwiseAND(1) == 0).select("symbol", "relative_path", "range", "ordinal")
