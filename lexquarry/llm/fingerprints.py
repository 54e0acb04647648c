"""Document fingerprints: Merkle trees over sections, paragraphs and sentences, in native expressions only.

Sections are split at empty lines, paragraphs at line ends, and the leaves of a paragraph after sentence ends or every
256 characters. A paragraph hashes its leaves, a section its paragraphs, the root its sections, so equal roots mean equal
texts and the first branches that differ locate an edit. The fingerprint is `root:sections:leaves`: 64 hex digits, 16
a section and 8 a leaf. Likeness is Dice's coefficient of two fingerprints' leaf sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import settle, texts

#: Ids of a range within which successors are found; ranges hold ids only, never texts.
RANGE_IDS = 20_000

#: A leaf: the least run of at most 256 characters that ends a sentence, else 256 characters or what is left.
_LEAF = r"(?s).{0,254}?[.!?] |.{1,256}"


def tree(text: Column) -> Column:
    """The tree of a text: array of sections, each an array of paragraphs, each an array of leaf hashes."""
    pieces = lambda p: F.when(p == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(p, F.lit(_LEAF), F.lit(0)))
    leaves = lambda p: F.transform(pieces(p), lambda s: F.md5(s.cast("binary")))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), leaves))


def _section_hashes(t: Column) -> Column:
    digest = lambda parts: F.sha2(F.array_join(parts, "").cast("binary"), 256)
    return F.transform(t, lambda s: digest(F.transform(s, digest)))


def root(t: Column) -> Column:
    return F.sha2(F.array_join(_section_hashes(t), "").cast("binary"), 256)


def tags(t: Column) -> Column:
    """The first 8 digits of the leaves, in order."""
    return F.transform(F.flatten(F.flatten(t)), lambda x: F.left(x, F.lit(8)))


def render(sections: Column, leaf_tags: Column) -> Column:
    """The fingerprint's text, from the section hashes and leaf tags."""
    return F.concat_ws(":", F.sha2(F.array_join(sections, "").cast("binary"), 256), F.array_join(F.transform(sections, lambda x: F.left(x, F.lit(16))), ""), F.array_join(leaf_tags, ""))


def likeness(a: Column, b: Column) -> Column:
    """Dice's coefficient of two arrays of leaf tags, 0 to 1; 1 for equal texts."""
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)))


def fingerprint(text: Column) -> Column:
    t = tree(text)
    return render(_section_hashes(t), tags(t))


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Positions of sections and paragraphs (from 0) at which two trees first hold different branches: array<struct<section, paragraph>>."""
    digest = lambda parts: F.sha2(F.array_join(parts, "").cast("binary"), 256)
    pairs = F.arrays_zip(F.transform(a, lambda s: F.transform(s, digest)).alias("x"), F.transform(b, lambda s: F.transform(s, digest)).alias("y"))
    empty = F.array().cast("array<string>")
    each = F.transform(
        pairs,
        lambda p, i: F.filter(
            F.transform(F.arrays_zip(F.coalesce(p["x"], empty).alias("u"), F.coalesce(p["y"], empty).alias("v")), lambda q, j: F.struct(i.alias("section"), j.alias("paragraph"), q["u"].eqNullSafe(q["v"]).alias("same"))),
            lambda q: ~q["same"],
        ),
    )
    return F.transform(F.flatten(each), lambda q: F.struct(q["section"], q["paragraph"]))


def successors(ids: DataFrame) -> DataFrame:
    """(doc_id, half, next_id) for the distinct ids of `ids` (doc_id, half); the last id is followed by the first.

    Ids are ordered within ranges of about RANGE_IDS; the first id of each range follows the range before. So no task orders
    all ids, only the ranges' first ones. `half` is the largest of an id's rows.
    """
    ids = ids.where("doc_id is not null").groupBy("doc_id").agg(F.max("half").alias("half"))
    n, low = ids.agg(F.count("*"), F.min("doc_id")).first()
    if not n:
        return ids.withColumn("next_id", F.col("doc_id"))
    ids = settle(ids.repartitionByRange(max(2, n // RANGE_IDS), "doc_id").withColumn("part", F.spark_partition_id()))
    firsts = ids.groupBy("part").agg(F.min("doc_id").alias("first"))  # one row a range
    following = firsts.select("part", F.coalesce(F.lead("first").over(Window.orderBy("part")), F.lit(low)).alias("after"))
    led = ids.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    return led.join(following, "part").select("doc_id", "half", F.coalesce("next_id", "after").alias("next_id"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's.

    The edited text's last floor(n_chars / 2) characters are the first as many (or all) of the next document by ascending
    doc_id; the last is followed by the first. Null texts count as empty. Of rows with one id, the least text follows;
    each of them is followed by the next larger id. A row without id is followed by an empty text. All characters are code points.
    """
    if docs.schema["doc_id"].dataType != T.LongType():
        docs = texts(docs)
    # No alias on doc_id: the exchange of texts by it must be the same on both sides of the join, to be used twice.
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    own, lost = docs.where("doc_id is not null"), docs.where("doc_id is null")
    after = successors(own.select("doc_id", half.alias("half")))
    first = own
    if own.groupBy("doc_id").count().where("count > 1").limit(1).count():
        first = own.groupBy("doc_id").agg(F.min("text").alias("text"))
    # Texts move once, by doc_id; from there each row sends its predecessor the beginning that the edit takes, and its leaves.
    packed = F.array_join(tags(tree(F.col("text"))), "")
    sent = first.join(after.select(F.col("doc_id").alias("to"), "half", F.col("next_id").alias("doc_id")), "doc_id")
    sent = sent.select(F.col("to").alias("doc_id"), F.left("text", F.col("half")).alias("beginning"), packed.alias("next_leaves"))
    lost = lost.select("doc_id", "text", F.lit("").alias("beginning"), F.array_join(tags(tree(F.lit(""))), "").alias("next_leaves"))
    pair = own.join(sent, "doc_id").select("doc_id", "text", "beginning", "next_leaves").unionByName(lost)
    edited = F.concat(F.left("text", F.length("text") - half), F.left("beginning", half))
    pair = pair.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "next_leaves")
    leaves = F.transform(F.sequence(F.lit(0), F.floor(F.length("next_leaves") / 8).cast("int") - 1), lambda i: F.substring(F.col("next_leaves"), i * 8 + 1, F.lit(8)))
    pair = pair.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), tree(F.col("text")).alias("t"), tree(F.col("edited")).alias("te"), leaves.alias("an"))
    pair = pair.select("doc_id", "n_chars", "edited_sha256", _section_hashes(F.col("t")).alias("s"), tags(F.col("t")).alias("a"), _section_hashes(F.col("te")).alias("se"), tags(F.col("te")).alias("ae"), "an")
    return pair.select(
        "doc_id", "n_chars", "edited_sha256",
        render(F.col("s"), F.col("a")).alias("fingerprint"), render(F.col("se"), F.col("ae")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("ae")).alias("near_edited"), likeness(F.col("a"), F.col("an")).alias("near_next"),
    )
