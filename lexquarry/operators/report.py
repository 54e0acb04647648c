"""The index report from reference counts that can be merged and taken back.

A fact is (kind, key, n, size): how many rows of the corpus hold a token, suffix, MIME type, name or path, and what sizes they add up
to. Facts of changed rows alone, negative for the old ones and positive for the new ones, are added to stored facts; a key whose
count falls to zero is gone. Every column of the report is a count or sum over facts, so one pass over them gives all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import token_set
from ..sources.fstree import IGNORED_NAMES
from .corpus import Corpus, hold
from .counts import counted


def _fact(kind: str, key: Column, size: Column | int = 0, n: Column | int = 1) -> Column:
    size = F.lit(size) if isinstance(size, int) else F.coalesce(size, F.lit(0))
    n = F.lit(n) if isinstance(n, int) else n
    return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), n.cast("long").alias("n"), size.cast("long").alias("size"))


def _rows(df: DataFrame, found: Column) -> DataFrame:
    return df.select(F.explode(found).alias("f")).select("f.*")


def facts(c: Corpus, sign: int = 1) -> DataFrame:
    """The facts of a corpus, or of the part of one; negative with sign -1. Null suffixes, MIME types and names are no facts."""
    present = lambda *fs: F.filter(F.array(*fs), lambda f: f["key"].isNotNull())
    kinds = F.array(_fact("entry", F.col("entry_type"), F.when(F.col("entry_type") == "file", F.col("size_bytes"))))
    named = F.transform(token_set(F.concat_ws(" ", "name", "path")), lambda t: _fact("path_token", t))
    rows = _rows(c.entries, F.concat(kinds, present(_fact("suffix", F.lower("suffix")), _fact("mime", F.lower("mime_type"))), named))
    # A document is one fact of as many rows as it has terms, and one for each token of its body.
    document = F.filter(F.array(_fact("document", F.col("path"), F.col("dl"), F.col("n_terms"))), lambda f: f["n"] > 0)
    in_body = F.transform(F.filter(F.arrays_zip("terms", "bodies"), lambda t: t["bodies"] > 0), lambda t: _fact("content_token", t["terms"]))
    rows = rows.unionByName(_rows(counted(c), F.concat(document, in_body)))
    rows = rows.unionByName(_rows(c.bodies, F.array(_fact("text", F.lit(""), F.col("size_bytes")))))
    is_test = F.when(F.coalesce("is_test", F.lit(False)), "test").otherwise("other")
    rows = rows.unionByName(_rows(c.symbols, F.concat(F.array(_fact("symbol", is_test)), present(_fact("python_file", F.col("path"))))))
    rows = rows.unionByName(_rows(c.refs, present(_fact("reference", F.col("name")), _fact("python_file", F.col("path")))))
    return rows.groupBy("kind", "key").agg((F.sum("n") * sign).alias("n"), (F.sum("size") * sign).alias("size"))


def part(c: Corpus, paths: DataFrame) -> Corpus:
    """The rows of some paths of a corpus; their tokens are made from them alone."""
    only = lambda df: df.join(paths.select("path"), "path", "left_semi")
    return Corpus(only(c.entries), only(c.texts), only(c.symbols), only(c.refs))


def merged(*tables: DataFrame) -> DataFrame:
    """Facts added up, without those that are gone."""
    return reduce(DataFrame.unionByName, tables).groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).where("n <> 0")


def updated(stored: DataFrame, old: Corpus, new: Corpus, changes: DataFrame) -> DataFrame:
    """Stored facts of `old` turned into those of `new`: only the rows of changed paths (path, change) are read and tokenised."""
    changes = hold(changes.select("path"))
    return merged(stored, facts(part(old, changes), -1), facts(part(new, changes)))


def report(table: DataFrame, root: str, last_built_at: float | None = None, ignored: tuple[str, ...] = IGNORED_NAMES) -> DataFrame:
    """One row with the 27 columns of an index's report, in one pass over its facts; zeros for none."""
    is_kind = lambda kind, key=None: (F.col("kind") == kind) & (F.lit(True) if key is None else F.col("key") == key)
    total = lambda of, kind, key=None: F.coalesce(F.sum(F.when(is_kind(kind, key), F.col(of))), F.lit(0)).cast("long")
    keys = lambda kind: F.count(F.when(is_kind(kind), 1))
    lengths = total("size", "document")
    columns = {
        "indexed": F.lit(True), "root": F.lit(root).cast("string"), "last_built_at": F.lit(last_built_at).cast("double"), "total_entries": total("n", "entry"), "total_files": total("n", "entry", "file"),
        "total_directories": total("n", "entry", "directory"), "total_symlinks": total("n", "entry", "symlink"), "total_size_bytes": total("size", "entry", "file"), "token_count": keys("path_token"),
        "content_token_count": keys("content_token"), "suffix_count": keys("suffix"), "mime_count": keys("mime"), "text_files_indexed": total("n", "text"), "text_bytes_indexed": total("size", "text"),
        "python_symbol_count": total("n", "symbol"), "python_test_symbol_count": total("n", "symbol", "test"), "python_file_count": keys("python_file"), "python_reference_name_count": keys("reference"), "bm25_ready": F.lit(True),
        "bm25_backend": F.lit("cpu"), "bm25_loaded_in_memory": F.lit(True), "bm25_loaded_in_gpu": F.lit(False), "bm25_documents": keys("document"),
        "bm25_avg_document_length": F.coalesce(F.try_divide(lengths, keys("document")), F.lit(0.0)), "scip_available": F.lit(False), "scip_loaded": F.lit(False), "ignored_names": F.array(*[F.lit(x) for x in sorted(ignored)]),
    }
    return table.agg(*[v.alias(k) for k, v in columns.items()])
