"""Highlighting, line scores and excerpts as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import let, lines, rstrip, strip

MARK, PLAIN, DIVIDER, ELLIPSIS = "► ", "  ", "\n--- (next match) ---\n", "…"


def _longest_first(terms: Column) -> Column:
    order = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    return F.array_sort(F.array_distinct(terms), order)


def highlight(text: Column, terms: Column) -> Column:
    """Each term in double brackets, longest first and whatever its case; later terms also mark inside earlier marks."""
    return F.aggregate(_longest_first(terms), text, lambda s, t: F.regexp_replace(s, F.concat(F.lit("(?i)"), t), F.lit("[[$0]]")))


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - 1)), F.lit(ELLIPSIS))).otherwise(text)


def line_scores(text_lines: Column, terms: Column) -> Column:
    """Occurrences of the terms, repeats counted, in each lower-cased line."""
    count = lambda low, t: ((F.length(low) - F.length(F.replace(low, t, F.lit("")))) / F.length(t)).cast("int")
    return F.transform(text_lines, lambda x: let(F.lower(x), lambda low: F.aggregate(terms, F.lit(0), lambda a, t: a + count(low, t))))


def proximity_boost(text_lines: Column, terms: Column) -> Column:
    """A quarter of: 3 a line with all distinct terms, 0.4 a term of a line with two or more; 5 at most. 0 for a single term."""
    distinct = F.array_distinct(terms)
    hits = lambda x: let(F.lower(x), lambda low: F.size(F.filter(distinct, lambda t: F.contains(low, t))))
    step = lambda acc, x: acc + let(hits(x), lambda n: F.when(n >= F.size(distinct), F.lit(3.0)).when(n >= 2, 0.4 * n).otherwise(F.lit(0.0)))
    return F.when((F.size(terms) >= 2) & text_lines.isNotNull(), F.least(F.aggregate(text_lines, F.lit(0.0), step), F.lit(5.0)) * 0.25).otherwise(F.lit(0.0))


def greedy_centers(hits: Column, context: int = 3, clusters: int = 2) -> Column:
    """Of lines (neg: the score times -1, idx: from 0) the best ones that are over two contexts apart, in document order."""
    pick = lambda acc, h: F.when((F.size(acc) < clusters) & ~F.exists(acc, lambda c: F.abs(c - h["idx"]) <= 2 * context), F.concat(acc, F.array(h["idx"]))).otherwise(acc)
    return F.array_sort(F.aggregate(F.array_sort(hits), F.array().cast("array<int>"), pick))


def cluster_centers(scores: Column, context: int = 3, clusters: int = 2) -> Column:
    """Lines (from 0) with the best scores that are over two contexts apart, in document order."""
    hits = F.filter(F.transform(scores, lambda s, i: F.struct((-s).alias("neg"), i.alias("idx"))), lambda h: h["neg"] < 0)
    return greedy_centers(hits, context, clusters)


def excerpt(path: Column, text: Column, terms: Column, max_chars: int = 220, context: int = 3, clusters: int = 2) -> Column:
    """Best windows of a text for the query terms; the first line that isn't blank without terms; null without text or anything to show."""
    numbered = lambda ls, lo, hi: F.filter(F.transform(F.sequence(lo, hi), lambda i: F.struct((i + 1).alias("n"), strip(F.get(ls, i)).alias("s"))), lambda x: x["s"] != "")

    def window(ls: Column, center: Column) -> Column:
        near = numbered(ls, F.greatest(center - context, F.lit(0)), F.least(center + context, F.size(ls) - 1))
        return F.array_join(F.transform(near, lambda x: F.concat(F.when(x["n"] - 1 == center, MARK).otherwise(PLAIN), F.lit("line "), x["n"].cast("string"), F.lit(": "), truncate(highlight(x["s"], terms), max_chars))), "\n")

    def first(ls: Column, shown: Callable[[Column], Column]) -> Column:
        return let(F.get(numbered(ls, F.lit(0), F.size(ls) - 1), F.lit(0)), lambda x: F.concat(F.lit("line "), shown(x), F.lit(": "), F.left(x["s"], F.lit(max_chars))))

    def found(ls: Column) -> Column:
        centers = cluster_centers(line_scores(ls, terms), context, clusters)
        by_path = F.when(F.exists(terms, lambda t: F.contains(F.lower(path), t)), F.concat(F.lit("path match: "), highlight(path, terms)))
        return let(
            F.filter(F.transform(centers, lambda c: window(ls, c)), lambda w: w != ""),
            lambda w: F.when(F.size(w) > 0, F.array_join(w, DIVIDER)).otherwise(F.coalesce(by_path, first(ls, lambda _: F.lit("1")))),
        )

    return F.when(text.isNull(), None).otherwise(let(lines(text), lambda ls: F.when(F.size(terms) == 0, first(ls, lambda x: x["n"].cast("string"))).otherwise(found(ls))))


def symbol_excerpt(text: Column, line: Column, end_line: Column, terms: Column, max_lines: int = 6, max_chars: int = 240) -> Column:
    """A symbol's lines and up to five after it, numbered and highlighted; null without text or lines."""
    ls = lines(text)
    start = F.greatest(line - 1, F.lit(0))
    end = F.least(F.size(ls), F.greatest(end_line, line) + max_lines - 1)
    rows = F.filter(F.transform(ls, lambda x, i: F.when((i >= start) & (i < end), F.concat(F.lit("line "), (i + 1).cast("string"), F.lit(": "), truncate(highlight(rstrip(x), terms), max_chars)))), lambda x: x.isNotNull())
    return F.when(F.size(rows) > 0, F.array_join(rows, "\n"))
