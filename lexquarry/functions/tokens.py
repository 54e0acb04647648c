"""Identifier tokens as Column expressions, and the same rule for query strings on the driver."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_ALNUM = "[^a-zA-Z0-9]+"
#: Words without inner boundaries, whose only part is the word itself.
SIMPLE = "^(?:[A-Za-z][a-z0-9]*|[0-9]+)$"
CAMEL = "[A-Z][a-z0-9]+|[A-Z]{2,}(?=[A-Z][a-z]|[0-9]|$)|[a-z][a-z0-9]*|[0-9]+"

# Words that the weighted document vectors leave out. Queries and postings keep them.
STOP_WORDS = (
    "def class return import from self none true false if else elif for while try except with as in pass raise yield lambda "
    "global nonlocal del assert const let var function export default async await typeof instanceof prototype fn mut pub use "
    "mod impl match where trait derive unsafe move ref dyn func package type interface chan defer go void char static extern "
    "inline typedef unsigned signed long short struct enum public private protected final abstract override extends implements "
    "super throws null nil undefined this that"
).split()

_STOP_SET = frozenset(STOP_WORDS)

#: Line ends that Python's text model knows, as one separator.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_SPACE = r"[\s\x1c-\x1f]"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f's expression (or a lambda in it) reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def raw_words(v: Column) -> Column:
    """Maximal runs of ASCII letters and digits."""
    return F.filter(F.split(v, NOT_ALNUM), lambda x: x != "")


def word_at(v: Column, i: int) -> Column:
    """raw_words()[i]; null without it. What stands after the word is not read."""
    found = F.regexp_extract(v, rf"^[^a-zA-Z0-9]*+(?:[a-zA-Z0-9]++[^a-zA-Z0-9]++){{{i}}}([a-zA-Z0-9]++)", 1)
    return F.when(found != "", found)


def identifier_parts(token: Column) -> Column:
    """The lower-cased token, then its camel-case parts of two or more characters that differ from it."""
    whole = F.lower(token)
    parts = F.transform(F.regexp_extract_all(token, F.lit(CAMEL), F.lit(0)), lambda p: F.lower(p))
    return F.when(token.rlike(SIMPLE), F.array(whole)).otherwise(F.concat(F.array(whole), F.filter(parts, lambda p: (p != whole) & (F.length(p) >= 2))))


def terms(v: Column) -> Column:
    """Ordered tokens with repeats."""
    return F.flatten(F.transform(raw_words(v), identifier_parts))


def token_set(v: Column) -> Column:
    return F.array_distinct(terms(v))


def indexed(term: Column) -> Column:
    """Whether a token counts in the weighted document vectors: two or more characters, and no stop word."""
    return (F.length(term) >= 2) & ~term.isin(STOP_WORDS)


def is_indexed(term: str) -> bool:
    """indexed() for one token."""
    return len(term) >= 2 and term not in _STOP_SET


def index_terms(v: Column) -> Column:
    """Tokens of two or more characters that are no stop words."""
    return F.filter(terms(v), indexed)


def query_terms(text: str) -> list[str]:
    """terms() for one string on the driver; callers lower-case where the rule says so."""
    out: list[str] = []
    for token in re.findall("[a-zA-Z0-9]+", text):
        whole = token.lower()
        out += [whole, *(p for p in map(str.lower, re.findall(CAMEL, token)) if p != whole and len(p) >= 2)]
    return out


def lines(text: Column) -> Column:
    """Lines without their ends; a text without any is its own only line."""
    s = F.split(text, LINE_ENDS, -1)
    return F.when((F.size(s) > 1) & (F.element_at(s, -1) == ""), F.slice(s, F.lit(1), F.size(s) - 1)).otherwise(s)


def strip(v: Column) -> Column:
    """Without white space, as Unicode defines it, at both ends."""
    return F.regexp_replace(v, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def rstrip(v: Column) -> Column:
    return F.regexp_replace(v, rf"(?U){_SPACE}+$", "")


def stem(name: Column) -> Column:
    """A file name up to its last dot."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def short_name(dotted: Column) -> Column:
    return F.element_at(F.split(dotted, r"\."), -1)


def parent_path(path: Column) -> Column:
    """Parent of a path; null for the root."""
    return F.when(path == ".", None).when(F.instr(path, "/") == 0, ".").otherwise(F.regexp_extract(path, "^(.*)/[^/]*$", 1))


def suffix_of(name: Column) -> Column:
    """From the last dot on, unless that is the first character."""
    s = F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1)
    return F.when(s != "", s)


def normalize_path(path: Column) -> Column:
    """Trimmed, without one leading `./` and outer slashes; blank is the root."""
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(path), r"^\./", ""), "^/+", ""), "/+$", "")
    return F.when(p == "", ".").otherwise(p)


def under(path: Column, prefix: str) -> Column:
    """Equal to a directory's path or below it."""
    return (path == prefix) | path.startswith(prefix + "/")


def walk_key(path: Column) -> Column:
    """Sorts paths in depth-first order, siblings by lower-cased name; the root first."""
    return F.when(path == ".", F.array().cast("array<string>")).otherwise(F.transform(F.split(path, "/"), lambda x: F.lower(x)))
