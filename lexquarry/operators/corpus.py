"""The index of a corpus as plain tables: tokens, weighted document terms and collection statistics.

A text is tokenised for `postings`: one row a document and token, with the token's weighted frequency and its count in the
body. The tables of content tokens, document terms and statistics follow from it; lengths too, where it is held, else from `counts`.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import token_set
from ..sources.fstree import IGNORED_NAMES, is_text_entry
from .counts import counted, each_term

#: The constants of BM25.
K1, B = 1.5, 0.75

SYMBOLS = (
    "name string, qualname string, kind string, path string, line int, end_line int, parent string, is_test boolean, docstring string, "
    "inherits array<string>, calls array<string>, signature string, language string, ordinal int"
)
REFS = "name string, path string, cnt long, ordinal int"
DEFINING = ("class", "function", "method", "struct", "enum", "union", "macro")


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names, or the one of the checkpoints; a temporary one only where both are unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="lexquarry-"))
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def hold(df: DataFrame) -> DataFrame:
    """The rows as they are now, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_rows(df: DataFrame) -> DataFrame:
    """The rows as they are now, as Parquet in the shared folder: for many columns and long lists, of which readers take some."""
    at = f"{shared_folder(df.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


@dataclass
class Corpus:
    """entries and texts are given; symbols and refs may be empty. The other tables follow from them, lazily."""

    entries: DataFrame
    texts: DataFrame
    symbols: DataFrame | None = None
    refs: DataFrame | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    #: Whether the tables are cached or stored.
    held: bool = False

    def __post_init__(self) -> None:
        spark = self.spark
        if self.symbols is None:
            self.symbols = spark.createDataFrame([], SYMBOLS).where(F.lit(False))  # so that joins with it are planned as none
        if self.refs is None:
            self.refs = spark.createDataFrame([], REFS).where(F.lit(False))

    @property
    def spark(self) -> SparkSession:
        return self.entries.sparkSession

    @property
    def has_postings(self) -> bool:
        """Whether postings are held, so that reading them tokenises nothing."""
        return self.held and "postings" in self.tables

    def __getattr__(self, name: str) -> DataFrame:
        make = _TABLES.get(name)
        if make is None:
            raise AttributeError(name)
        if name not in self.tables:
            self.tables[name] = make(self)
        return self.tables[name]

    def cache(self) -> Corpus:
        """Holds all tables that queries read in executor memory and disk. Postings lie in the order of their terms, in ranges that
        also split frequent terms, so that a query for some terms skips what holds none of them."""
        self.tables, self.held = {}, True
        for name in ("entries", "symbols", "refs"):
            setattr(self, name, getattr(self, name).cache())
        for name in ("bodies", "path_tokens", "postings", "term_stats", "doc_lengths", "corpus_stats", "doc_stats"):
            df = getattr(self, name)
            if name == "postings":
                df = df.repartitionByRange("term", "path").sortWithinPartitions("term", "path")
            self.tables[name] = df.cache()
        return self

    def unpersist(self) -> None:
        for df in [self.entries, self.symbols, self.refs, *self.tables.values()]:
            df.unpersist()
        self.held = False


def _bodies(c: Corpus) -> DataFrame:
    """Texts that count as content: of text entries, with at least one token."""
    own = c.texts.join(c.entries.where(is_text_entry()).select("path", "size_bytes"), "path")
    return own.where(F.col("text").rlike("[A-Za-z0-9]"))


def _path_tokens(c: Corpus) -> DataFrame:
    return c.entries.select("path", F.explode(token_set(F.concat_ws(" ", "name", "path"))).alias("token"))


def _postings(c: Corpus) -> DataFrame:
    """(path, term, tf, in_body) of all tokens: weighted occurrences in all fields, 0 for tokens that aren't indexed, and occurrences in the body."""
    return each_term(counted(c), "path")


def _content_tokens(c: Corpus) -> DataFrame:
    return c.postings.where("in_body > 0").select("path", F.col("term").alias("token"))


def _doc_terms(c: Corpus) -> DataFrame:
    return c.postings.where("tf > 0").select("path", "term", "tf")


def _term_stats(c: Corpus) -> DataFrame:
    return c.doc_terms.groupBy("term").agg(F.count("*").alias("df"))


def _doc_lengths(c: Corpus) -> DataFrame:
    """The weighted token counts of the fields. Documents without tokens have no row."""
    if c.has_postings:
        return c.doc_terms.groupBy("path").agg(F.sum("tf").alias("dl"))
    return counted(c, []).where("dl > 0").select("path", "dl")


def _corpus_stats(c: Corpus) -> DataFrame:
    """One row: documents with terms, and their average length."""
    return c.doc_lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def norm(dl: Column, avgdl: Column) -> Column:
    return K1 * (1 - B + B * dl / avgdl)


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Adds the columns of a table of one row, which is broadcast."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one")


def _doc_stats(c: Corpus) -> DataFrame:
    return beside(c.doc_lengths, c.corpus_stats).select("path", "dl", norm(F.col("dl"), F.col("avgdl")).alias("norm"))


_TABLES = {
    "bodies": _bodies, "path_tokens": _path_tokens, "postings": _postings, "content_tokens": _content_tokens, "doc_terms": _doc_terms, "term_stats": _term_stats,
    "doc_lengths": _doc_lengths, "corpus_stats": _corpus_stats, "doc_stats": _doc_stats,
}


def totals(entries: DataFrame) -> DataFrame:
    """One row: entries, files, directories, links and the files' bytes."""
    kind = lambda k: F.sum((F.col("entry_type") == k).cast("long"))
    return entries.agg(
        F.count("*").alias("total_entries"), F.coalesce(kind("file"), F.lit(0)).alias("total_files"), F.coalesce(kind("directory"), F.lit(0)).alias("total_directories"),
        F.coalesce(kind("symlink"), F.lit(0)).alias("total_symlinks"), F.coalesce(F.sum(F.when(F.col("entry_type") == "file", F.col("size_bytes"))), F.lit(0)).alias("total_size_bytes"),
    )


def children(entries: DataFrame, path: str) -> DataFrame:
    return entries.where(F.col("parent_path") == path).orderBy(F.lower("path"), "path")


def children_counts(entries: DataFrame) -> DataFrame:
    """(path, children_count) of all directories, empty ones included."""
    kids = entries.where("parent_path is not null").groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("c"))
    return entries.where(F.col("entry_type") == "directory").select("path").join(kids, "path", "left").select("path", F.coalesce("c", F.lit(0)).alias("children_count"))


def stats(c: Corpus, root: str, indexed: bool = True, last_built_at: float | None = None, ignored: tuple[str, ...] = IGNORED_NAMES) -> DataFrame:
    """The index report as one row: 27 columns of an index, 25 of none."""
    lit = lambda v, t, n: F.lit(v).cast(t).alias(n)
    names = F.array(*[F.lit(x) for x in sorted(ignored)]).alias("ignored_names")
    if not indexed:
        zero = ["total_entries", "total_files", "total_directories", "total_symlinks", "total_size_bytes", "token_count", "content_token_count", "suffix_count", "mime_count", "text_files_indexed", "text_bytes_indexed", "python_symbol_count", "python_test_symbol_count", "python_file_count", "python_reference_name_count"]
        return c.spark.range(1).select(
            F.lit(False).alias("indexed"), lit(None, "string", "root"), lit(last_built_at, "double", "last_built_at"), *[lit(0, "long", z) for z in zero], F.lit(False).alias("bm25_ready"), F.lit("cpu").alias("bm25_backend"),
            F.lit(False).alias("bm25_loaded_in_memory"), F.lit(False).alias("bm25_loaded_in_gpu"), lit(0, "long", "bm25_documents"), lit(0.0, "double", "bm25_avg_document_length"), names,
        )
    parts = [
        c.path_tokens.agg(F.count_distinct("token").alias("token_count")),
        c.content_tokens.agg(F.count_distinct("token").alias("content_token_count")),
        c.entries.agg(F.count_distinct(F.lower("suffix")).alias("suffix_count"), F.count_distinct(F.lower("mime_type")).alias("mime_count")),
        c.bodies.agg(F.count("*").alias("text_files_indexed"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("text_bytes_indexed")),
        c.symbols.agg(F.count("*").alias("python_symbol_count"), F.coalesce(F.sum(F.col("is_test").cast("long")), F.lit(0)).alias("python_test_symbol_count")),
        c.symbols.select("path").union(c.refs.select("path")).agg(F.count_distinct("path").alias("python_file_count")),
        c.refs.agg(F.count_distinct("name").alias("python_reference_name_count")),
        c.corpus_stats.select(F.lit(True).alias("bm25_ready"), F.lit("cpu").alias("bm25_backend"), F.lit(True).alias("bm25_loaded_in_memory"), F.lit(False).alias("bm25_loaded_in_gpu"), F.col("n").alias("bm25_documents"), F.col("avgdl").alias("bm25_avg_document_length")),
    ]
    out = totals(c.entries).select(F.lit(True).alias("indexed"), lit(root, "string", "root"), lit(last_built_at, "double", "last_built_at"), "*")
    for p in parts:
        out = beside(out, p)
    return out.select("*", F.lit(False).alias("scip_available"), F.lit(False).alias("scip_loaded"), names)
