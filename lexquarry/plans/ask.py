"""Rule-parsed questions in English and Russian: parsing as Column expressions, and the plans and answers they lead to."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.excerpts import excerpt, symbol_excerpt
from ..functions.tokens import query_terms
from ..operators import search as searching
from ..operators import xref
from ..operators.corpus import Corpus

# The words and patterns by which questions are read.
STOPWORDS = (
    "a all and are does find for from get function in is lay lies list located me of on only path paths class search show the there these tests test use used uses "
    "where who with в все внутри где директории директория для есть и из какие какой какую каталог каталоги класс класса классы лежит лежат ли мне найди найти находится "
    "находятся папка папки покажи показать по путь пути с содержимом содержимому содержимое список тест тесты текст тексте только использует используется используют метод "
    "методы функция функции файл файла файле файлов что"
).split()
FILE_WORDS = "file files файл файла файле файлы файлов".split()
DIRECTORY_WORDS = "dir dirs directory directories folder folders директория директории каталог каталоги папка папки".split()
CONTENT_WORDS = "content contents inside text содержимое содержимому содержимом внутри текст тексте".split()
LOCATION_WORDS = "where located lies path paths где лежит лежат находится находятся путь пути".split()
LIST_WORDS = "all list show все список покажи показать".split()
FUNCTION_WORDS = "function functions func функция функции".split()
CLASS_WORDS = "class classes класс классы класса".split()
METHOD_WORDS = "method methods метод методы".split()
TEST_WORDS = "test tests тест тесты".split()
USAGE_PATTERNS = ("кто использует", "где используется", "where is used", "who uses", "used by", "uses ")
SUFFIX_ALIASES = {
    "markdown": ".md", "md": ".md", "python": ".py", "py": ".py", "json": ".json", "yaml": ".yaml", "yml": ".yml", "toml": ".toml", "text": ".txt", "txt": ".txt",
    "лог": ".log", "логов": ".log", "логи": ".log", "markdown-файл": ".md", "маркдаун": ".md", "питон": ".py", "текст": ".txt",
}
PREFIX_PATTERNS = (
    r"path_prefix\s*[:=]\s*([A-Za-z0-9_./-]+)",
    r"(?:inside|under|within)\s+([A-Za-z0-9_./-]+)",
    r"(?:in\s+(?:folder|directory))\s+([A-Za-z0-9_./-]+)",
    r"(?:внутри|в папке|в директории|в каталоге|из папки|из директории|из каталога)\s+([A-Za-z0-9_./-]+)",
    r"(?U)\bв\s+([A-Za-z0-9_./-]+)\s*$",
)
WORD = r"[\p{L}\p{N}\p{M}]+"
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"

_KINDS = FILE_WORDS + DIRECTORY_WORDS + CONTENT_WORDS + LOCATION_WORDS + LIST_WORDS + FUNCTION_WORDS + CLASS_WORDS + METHOD_WORDS + TEST_WORDS
NO_SUBJECT = sorted({*STOPWORDS, *_KINDS})
NO_TERM = sorted({*NO_SUBJECT, *SUFFIX_ALIASES})


@dataclass(frozen=True)
class Parsed:
    question: str
    intent: str
    subject: str | None
    query: str
    content_query: str
    entry_type: str | None
    suffix: str | None
    symbol_kind: str | None
    path_prefix: str | None
    limit: int
    wants_location: bool
    wants_list: bool


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def prefix_candidates(lowered: Column) -> Column:
    """Path phrases of a lower-cased question, in the order of the patterns."""
    found = F.concat(*[_all(lowered, p, 1) for p in PREFIX_PATTERNS])
    clean = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, "^/+", ""), "/+$", ""))
    return F.array_distinct(F.filter(clean, lambda x: x != ""))


def resolve_prefixes(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds path_prefix: the first candidate that is a directory's path, or else the name of exactly one directory."""
    cands = questions.select("qid", F.posexplode("candidates").alias("i", "cand"))
    folders = entries.where((F.col("entry_type") == "directory")).select("path")
    exact = cands.join(folders, F.col("cand") == F.col("path")).select("qid", "i", "path")
    base = folders.where("path <> '.'").select(F.lower(F.element_at(F.split("path", "/"), -1)).alias("base"), "path")
    named = cands.join(base, F.lower("cand") == F.col("base")).groupBy("qid", "i").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").select("qid", "i", "path")
    best = exact.withColumn("o", F.lit(0)).unionByName(named.withColumn("o", F.lit(1))).groupBy("qid").agg(F.min_by("path", F.struct("i", "o")).alias("path_prefix"))
    return questions.join(best, "qid", "left")


def parse(questions: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """The parsed fields for each question (qid, question). Without entries the first path phrase is taken as it stands."""
    q = questions.select("qid", F.trim("question").alias("question"))
    q = q.withColumn("lowered", F.lower("question")).withColumn("words", _all(F.col("lowered"), WORD)).withColumn("candidates", prefix_candidates(F.col("lowered")))
    q = resolve_prefixes(q, entries) if entries is not None else q.withColumn("path_prefix", F.get("candidates", F.lit(0)))
    words = F.col("words")
    has = lambda values: F.exists(words, lambda w: w.isin(*values))
    prefix = F.coalesce("path_prefix", F.lit(""))
    own = lambda text, pattern: F.coalesce(_all(text, pattern), F.array().cast("array<string>"))
    subject = F.filter(_all(F.col("question"), IDENTIFIER), lambda x: ~F.lower(x).isin(*NO_SUBJECT) & ~F.array_contains(own(prefix, IDENTIFIER), x))
    q = q.withColumn("subject", F.try_element_at(subject, F.lit(-1)))
    kind = F.when(has(FUNCTION_WORDS), "function").when(has(CLASS_WORDS), "class").when(has(METHOD_WORDS), "method")
    content = has(CONTENT_WORDS) | F.contains("lowered", F.lit("по содержим"))
    payload = F.array_join(F.filter(words, lambda w: ~w.isin(*NO_TERM) & ~F.array_contains(own(F.lower(prefix), WORD), w)), " ")
    aliases = F.create_map(*[F.lit(x) for kv in SUFFIX_ALIASES.items() for x in kv])
    q = q.withColumns({"symbol_kind": kind, "content": content, "payload": payload, "wants_location": has(LOCATION_WORDS), "wants_list": has(LIST_WORDS)})
    used = F.lit(False)
    for p in USAGE_PATTERNS:
        used = used | F.contains("lowered", F.lit(p))
    intent = F.when(F.col("subject").isNull(), "search_files").when(used, "find_usage").when(has(TEST_WORDS), "find_tests").when(F.col("symbol_kind").isNotNull(), "find_symbol").otherwise("search_files")
    return q.select(
        "qid", "question", intent.alias("intent"), "subject", F.when(F.col("content"), "").otherwise(F.col("payload")).alias("query"), F.when(F.col("content"), F.col("payload")).otherwise("").alias("content_query"),
        F.when(has(FILE_WORDS), "file").when(has(DIRECTORY_WORDS), "directory").alias("entry_type"), F.get(F.transform(F.filter(words, lambda w: w.isin(*SUFFIX_ALIASES)), lambda w: aliases[w]), F.lit(0)).alias("suffix"),
        "symbol_kind", "path_prefix", F.when(F.col("wants_list"), 10).otherwise(5).alias("limit"), "wants_location", "wants_list",
    )


def parse_question(c: Corpus, question: str) -> Parsed:
    """One question, parsed; ValueError if it has no word."""
    rows = parse(c.spark.createDataFrame([(0, question)], "qid int, question string"), c.entries)
    row = rows.where(F.col("question").rlike(WORD)).drop("qid").first()
    if row is None:
        raise ValueError("question must not be empty")
    return Parsed(**row.asDict())


def _found(names: list[str], none: str, one: str, many: str) -> str:
    return none if not names else one if len(names) == 1 else many


def files_answer(p: Parsed, files: list[str]) -> str:
    noun = "директорий" if p.entry_type == "directory" else "файлов"
    within = f" внутри {p.path_prefix}" if p.path_prefix else ""
    first = ", ".join(files[:3])
    if p.wants_location:
        return _found(files, f"Ничего не нашёл по запросу: {p.question}", f"Самый релевантный путь{within}: {first}", f"Нашёл {len(files)} {noun}{within}. Самые релевантные пути: {first}")
    return _found(files, f"Ничего не нашёл по запросу: {p.question}", f"Нашёл 1 результат{within}: {first}", f"Нашёл {len(files)} {noun}{within}: {first}")


def ask(c: Corpus, question: str) -> dict:
    """question, parsed_query, answer, files and matches (and skeleton_dsl for symbols). Results have at most ten rows."""
    p = parse_question(c, question)
    out = {"question": p.question, "parsed_query": asdict(p)}
    if p.intent == "find_usage":
        rows = [r.asDict() for r in xref.usages(c, p.subject, p.path_prefix, p.limit).collect()]
        files = [r["path"] for r in rows]
        text = _found(files, f"Не нашёл usages для {p.subject}", f"{p.subject} используется в {', '.join(files)}", f"{p.subject} используется в {len(files)} файлах: {', '.join(files[:3])}")
        return out | {"answer": text, "files": files, "matches": rows}
    if p.intent in ("find_symbol", "find_tests"):
        tests = p.intent == "find_tests"
        if tests:
            found = xref.related_tests(c, p.subject, p.path_prefix, p.limit)
            order = [F.desc("score"), F.lower("path"), F.col("line"), F.col("ordinal")]
        else:
            found = xref.search_symbols(c, p.subject, p.symbol_kind, p.path_prefix, p.limit)
            if p.symbol_kind and not found.limit(1).count():
                found = xref.search_symbols(c, p.subject, None, p.path_prefix, p.limit)
            order = [F.lower("path"), F.col("line"), F.lower("qualname")]
        terms = F.array(*[F.lit(t) for t in query_terms(p.subject)]).cast("array<string>")
        shown = found.join(c.texts, "path", "left").withColumn("excerpt", symbol_excerpt(F.col("text"), F.col("line"), F.col("end_line"), terms)).orderBy(*order).collect()
        keys = ["path", "name", "qualname", "kind", "line", *([] if tests else ["end_line", "inherits", "calls", "signature"]), "excerpt"]
        files = list(dict.fromkeys(r["path"] for r in shown))
        label = p.symbol_kind or "symbol"
        one = shown[0] if shown else {"qualname": "", "path": "", "line": 0}
        at = f"{one['path']}:{one['line']}"
        if tests:
            text = _found(shown, f"Не нашёл тесты для {p.subject}", f"Нашёл тест для {p.subject}: {one['qualname']} в {at}", f"Нашёл {len(shown)} тестов для {p.subject}: {', '.join(files[:3])}")
        else:
            text = _found(shown, f"Не нашёл {label}: {p.subject}", f"{label.capitalize()} {one['qualname']} определён в {at}", f"Нашёл {len(shown)} определений для {p.subject}: {', '.join(files[:3])}")
            out["skeleton_dsl"] = xref.contour(c, xref.ranked_symbols(found), p.subject).first()[0]
        return out | {"answer": text, "files": files, "matches": [{k: r[k] for k in keys} for r in shown]}
    hits = searching.search(c, p.query, p.content_query, p.entry_type, p.suffix, p.path_prefix, p.limit)
    if p.entry_type == "directory" and not p.query and not p.content_query:
        hits = hits.where("path <> '.'")
    terms = F.array(*[F.lit(t) for t in query_terms(f"{p.query} {p.content_query}".strip())]).cast("array<string>")
    shown = hits.join(c.bodies.select("path", "text"), "path", "left").withColumn("excerpt", excerpt(F.col("path"), F.col("text"), terms)).orderBy(F.desc("score"), F.lower("path"), "path").collect()
    files = [r["path"] for r in shown]
    rows = [{"path": r["path"], "parent_path": r["parent_path"] or ".", "entry_type": r["entry_type"], "score": round(r["score"], 6), "excerpt": r["excerpt"]} for r in shown[:5]]
    return out | {"answer": files_answer(p, files), "files": files, "matches": rows}
