"""Corpora from tables: `documents` and `pages` as trees of text entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import parent_path, suffix_of, walk_key
from .fstree import TEXT_SUFFIXES, mime_of


def _entries(files: DataFrame, root_name: str) -> DataFrame:
    """Files (path, size_bytes) with all directories above them and the root."""
    parts = F.split("path", "/")
    above = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), n), "/")))).alias("path")).where("path is not null").distinct()
    folders = above.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.lit("directory").alias("entry_type"), F.lit(0).cast("long").alias("size_bytes"))
    root = files.sparkSession.range(1).select(F.lit(".").alias("path"), F.lit(root_name).alias("name"), F.lit("directory").alias("entry_type"), F.lit(0).cast("long").alias("size_bytes"))
    rows = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.lit("file").alias("entry_type"), "size_bytes").unionByName(folders).unionByName(root)
    rows = rows.withColumn("suffix", F.when(F.col("path") != ".", suffix_of(F.col("name"))))
    mime = F.create_map(*[F.lit(x) for s in TEXT_SUFFIXES for x in (s, mime_of(s) or "text/plain")])
    return rows.withColumn("mime_type", F.element_at(mime, F.lower("suffix"))).withColumn("parent_path", parent_path(F.col("path"))).withColumn("walk_key", walk_key(F.col("path")))


def document_paths(documents: DataFrame) -> DataFrame:
    """(path, text): source/lang/doc_<id>.txt for each document."""
    return documents.select(F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt"))).alias("path"), "text")


def from_documents(documents: DataFrame, root_name: str = "corpus") -> tuple[DataFrame, DataFrame]:
    """(entries, texts) of the documents table."""
    texts = document_paths(documents)
    return _entries(texts.select("path", F.octet_length("text").cast("long").alias("size_bytes")), root_name), texts


def from_pages(pages: DataFrame, root_name: str = "web") -> tuple[DataFrame, DataFrame]:
    """(entries, texts) of the pages table: host/path segments/page_<id>.html."""
    rest = F.regexp_extract("url", r"^[^:]*://([^?#]*)", 1)
    texts = pages.select(F.concat_ws("/", F.array_join(F.filter(F.split(rest, "/"), lambda x: x != ""), "/"), F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html"))).alias("path"), F.col("html").alias("text"))
    return _entries(texts.select("path", F.octet_length("text").cast("long").alias("size_bytes")), root_name), texts
