"""A data source for directory trees: `spark.read.format("fstree").option("path", root)`, and the same as a stream of snapshots.

Partitions are subtrees: directories are opened from the root down until there are PARTS of them. Symbolic links are not followed, unreadable directories are empty, and entries that
vanish during the scan are left out. Texts are read by read_texts(), apart from the entries, so that listings never open files.
"""

from __future__ import annotations

import mimetypes
import os
import re
import shutil
import stat
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition, StringStartsWith

from ..functions.tokens import parent_path, walk_key

# Names that the index leaves out wherever they occur in a path, and what counts as text.
IGNORED_NAMES = ("__pycache__", ".git", "node_modules", ".venv", ".venv_dd", "output", "vendor", "demos", ".pytest_cache", ".ruff_cache", "scratch", "autoresearch", "tymoczko_code")
TEXT_SUFFIXES = (".c .cfg .conf .cpp .css .csv .go .html .ini .java .js .json .log .md .py .rs .sh .sql .toml .ts .txt .xml .yaml .yml").split()
TEXT_MIMES = ("application/json", "application/sql", "application/xml")
MAX_TEXT_BYTES = 1024 * 1024

#: Subtrees that a listing is split into, about, and levels of directories that are opened for it; bytes of texts read at once.
PARTS, OPENED, READ_BYTES = 256, 4, 4 << 20

SCHEMA = (
    "path string, name string, entry_type string, size_bytes long, mode long, permissions string, uid long, gid long, inode long, device long, "
    "hard_links long, created_at double, modified_at double, accessed_at double, suffix string, mime_type string, is_symlink boolean, symlink_target string, error string"
)


def mime_of(suffix: str | None) -> str | None:
    return mimetypes.guess_type("x" + suffix)[0] if suffix else None


def _kind(mode: int) -> str:
    for test, name in ((stat.S_ISLNK, "symlink"), (stat.S_ISDIR, "directory"), (stat.S_ISREG, "file")):
        if test(mode):
            return name
    return "other"


def _row(full: str, rel: str, name: str) -> tuple | None:
    try:
        st = os.lstat(full)
    except OSError:
        return None
    link = stat.S_ISLNK(st.st_mode)
    try:
        target = os.readlink(full) if link else None
    except OSError:
        target = None
    at = name.rfind(".")
    suffix = name[at:] if at > 0 else None
    return (rel, name, _kind(st.st_mode), st.st_size, st.st_mode, stat.filemode(st.st_mode), st.st_uid, st.st_gid, st.st_ino, st.st_dev, st.st_nlink, st.st_ctime, st.st_mtime, st.st_atime, suffix, mime_of(suffix), link, target, None)


def _names(folder: str, ignored: frozenset[str]) -> list[str]:
    try:
        return [x for x in os.listdir(folder) if x not in ignored]
    except OSError:
        return []


def walk(root: str, rel: str, ignored: frozenset[str]) -> Iterator[tuple]:
    """The entry and, below a directory, all others."""
    todo = [rel]
    while todo:
        at = todo.pop()
        row = _row(os.path.join(root, at), at, os.path.basename(at))
        if row is None:
            continue
        yield row
        if row[2] == "directory":
            todo += [f"{at}/{x}" for x in _names(os.path.join(root, at), ignored)]


def _root(options: dict) -> tuple[str, frozenset[str]]:
    root = os.path.realpath(os.path.expanduser(options["path"]))
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    return root, frozenset(x for x in options.get("ignore", "").split(",") if x)


class _Part(InputPartition):
    """Entries to list: some one by one, others with all below them."""

    def __init__(self, alone: list[str], whole: list[str]) -> None:
        super().__init__(None)
        self.alone, self.whole = alone, whole


def _split(root: str, ignored: frozenset[str], prefix: str = "") -> list[_Part]:
    """The tree as partitions: directories are opened level by level until there are about PARTS subtrees. Only what may lie under `prefix` counts."""
    meets = lambda x: x.startswith(prefix) or prefix.startswith(x + "/")
    alone, level = ["."], [x for x in (_names(root, ignored) if os.path.isdir(root) else []) if meets(x)]
    for _ in range(OPENED):
        folders = [x for x in level if os.path.isdir(os.path.join(root, x)) and not os.path.islink(os.path.join(root, x))]
        if not folders or len(level) >= PARTS:
            break
        inner = set(folders)
        alone += folders
        level = [x for x in level if x not in inner] + [y for f in folders for x in _names(os.path.join(root, f), ignored) if meets(y := f"{f}/{x}")]
    size = -(-len(level) // PARTS) or 1
    return [_Part(alone, []), *(_Part([], level[i : i + size]) for i in range(0, len(level), size))]


def _read(root: str, ignored: frozenset[str], part: _Part) -> Iterator[tuple]:
    for rel in part.alone:
        full = root if rel == "." else os.path.join(root, rel)
        if row := _row(full, rel, os.path.basename(full) or full):
            yield row
    for rel in part.whole:
        yield from walk(root, rel, ignored)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.ignored = _root(options)
        self.prefix = ""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """A path prefix saves walking other branches; Spark applies every filter again."""
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.prefix = max(self.prefix, f.value, key=len)
            if isinstance(f, EqualTo) and f.attribute == ("path",) and isinstance(f.value, str):
                self.prefix = max(self.prefix, f.value, key=len)
            yield f

    def partitions(self) -> list[InputPartition]:
        return _split(self.root, self.ignored, self.prefix)

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from _read(self.root, self.ignored, partition)


class _Snapshots(DataSourceStreamReader):
    """Every micro-batch holds the whole tree as it then is, numbered by generation and listed by the tasks."""

    def __init__(self, options: dict) -> None:
        self.options, self.generation = options, 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"generation": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.generation += 1
        return {"generation": self.generation}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.generation = max(self.generation, end["generation"])
        try:
            return _split(*_root(self.options))
        except FileNotFoundError:
            return []

    def read(self, partition: _Part) -> Iterator[tuple]:
        try:
            root, ignored = _root(self.options)
        except FileNotFoundError:
            return
        yield from _read(root, ignored, partition)


class FsTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fstree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> _Snapshots:  # noqa: N802
        return _Snapshots(dict(self.options))


def complete(entries: DataFrame) -> DataFrame:
    """Adds parent_path, walk_key, children_count and the change signature to scanned entries."""
    e = entries.withColumn("parent_path", parent_path(F.col("path"))).withColumn("walk_key", walk_key(F.col("path")))
    kids = e.where("parent_path is not null").groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("children_count"))
    e = e.join(kids, "path", "left").withColumn("children_count", F.coalesce("children_count", F.lit(0).cast("long")))
    return e.withColumn("signature", F.struct("inode", F.col("size_bytes").alias("size"), F.col("modified_at").alias("mtime")))


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets path filters reach its reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FsTree)


def scan(spark: SparkSession, root: str, ignore: tuple[str, ...] | None = None) -> DataFrame:
    """All entries of a tree; ignore=IGNORED_NAMES is what the index uses, None keeps everything."""
    register(spark)
    if not os.path.exists(os.path.expanduser(root)):
        raise FileNotFoundError(root)
    return complete(spark.read.format("fstree").option("path", root).option("ignore", ",".join(ignore or ())).load())


def resolve_requested(root: str, requested: str) -> str:
    """The path of a request below the root; ValueError if it leaves it."""
    base = os.path.realpath(os.path.expanduser(root))
    full = os.path.realpath(os.path.join(base, requested or "."))
    if full != base and not full.startswith(base + os.sep):
        raise ValueError(f"path escapes the root: {requested}")
    return full


def is_text_entry() -> Column:
    """Files of 1 MiB or less with a text suffix or type."""
    mime = F.lower(F.coalesce("mime_type", F.lit("")))
    return (F.col("entry_type") == "file") & (F.col("size_bytes") <= MAX_TEXT_BYTES) & (F.lower(F.coalesce("suffix", F.lit(""))).isin(TEXT_SUFFIXES) | mime.startswith("text/") | mime.isin(*TEXT_MIMES))


def read_texts(entries: DataFrame, root: str) -> DataFrame:
    """(path, text) of the given entries; files that aren't strict UTF-8 have no row. Line ends become newlines."""
    base = os.path.realpath(os.path.expanduser(root))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, str]] = []
        size = 0
        for b in batches:
            for p in b.column(0).to_pylist():
                try:
                    with open(base if p == "." else os.path.join(base, p), encoding="utf-8") as f:
                        rows.append((p, f.read()))
                except (OSError, UnicodeDecodeError):
                    continue
                size += len(rows[-1][1])
                if size >= READ_BYTES:
                    yield pa.RecordBatch.from_pydict({"path": [x for x, _ in rows], "text": [x for _, x in rows]})
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pydict({"path": [x for x, _ in rows], "text": [x for _, x in rows]})

    return entries.select("path").mapInArrow(read, "path string, text string")


def write_files(texts: DataFrame, root: str) -> None:
    """Writes the texts (path, text; null: empty) as files below a folder that driver and executors share, as `file:` URI or path; a repeated path keeps one of its texts.

    Each task writes its own rows; a file appears whole, so a task that runs again changes nothing. A path that leaves the root fails.
    """
    base = os.path.realpath(os.path.expanduser(local_path(root)))
    drafts = f"{base}.drafts"
    for folder in (base, drafts):
        os.makedirs(folder, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                full = resolve_requested(base, p)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                draft = os.path.join(drafts, uuid.uuid4().hex)
                with open(draft, "wb") as f:
                    f.write((t or "").encode("utf-8", "surrogatepass"))
                os.replace(draft, full)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    texts.select("path", "text").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    shutil.rmtree(drafts, ignore_errors=True)


def local_path(path: str) -> str:
    """The path of a `file:` URI; other paths as they are. ValueError for other file systems, whose files a tree listing can't open."""
    at = re.match(r"([a-z][a-z0-9+.-]*):(?://[^/]*)?(/.*)", path)
    if at and at[1] != "file":
        raise ValueError(f"not a mounted folder: {path}")
    return at[2] if at else path
