"""URL filters: rules by host and path, and for all other urls a path-template tree with smoothed labelled purity.

Rules label the urls they fit. Per host, path segments become the levels of a tree: segments with digits, and segments
that are rare among very many siblings, become wildcards (`*`); sibling branches whose labelled shares don't differ
significantly from their parent's are merged (`*+`). The tree goes as deep as a node's pages suffice for either; below, no
segment can change. A `*` of a url is written `%2A`, so that it is no wildcard. A template is rejected when the blocked share of its labelled pages,
smoothed by that of the same template over all hosts and by the overall share, reaches a threshold. Only counts by template are gathered.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import salted_join, settle

#: Rules as (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Siblings and share from which a segment is a variable; weight of smoothing; threshold.
MANY, RARE, WEIGHT, REJECT = 50, 0.02, 5.0, 0.6
#: Standard score under which a branch's blocked share is not told apart from its siblings'.
SIMILAR = 1.64
#: Labelled pages that a branch needs before it can be merged; with fewer, likeness would only be lack of evidence.
EVIDENCE = 30

#: Characters of the distinct templates below a node up to which one task finishes it.
TASK_CHARS = 1 << 22

_LEAF = ["host", "segments", "n", "labelled", "blocked", "final"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, lower-cased A-Z) and path; both empty for a null url or one without ://."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    raw = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    lower = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower, path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (host followed by path), and its verdict; nulls without one."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def template(path: Column) -> Column:
    """Segments of a path, those with digits (file endings aside) as wildcards that keep the ending's kind."""
    one = lambda s: F.when(F.regexp_replace(s, r"\.[A-Za-z]{1,5}$", "").rlike(r"\d"), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1))).otherwise(F.replace(s, F.lit("*"), F.lit("%2A")))
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), one)


def _names(segs: Iterable[tuple[str, int, int, int]]) -> dict[str, str]:
    """Names in the template of one node's children (segment, pages, labelled, blocked): the same rule as in _level."""
    kids = list(segs)
    pages, labelled, blocked = (sum(k[i] for k in kids) for i in (1, 2, 3))
    p = blocked / max(labelled, 1)
    out = {}
    for seg, c, l, b in kids:
        alike = len(kids) > 1 and l >= EVIDENCE and abs(b - l * p) / math.sqrt(max(l * p * (1 - p), 0.25)) < SIMILAR and not seg.startswith("*")
        out[seg] = "*" if len(kids) > MANY and c < RARE * pages else "*+" if alike else seg
    return out


def _shared(a: list[str], b: list[str]) -> int:
    """How many segments two paths share from their start; of a list's least and greatest path, how many all share."""
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rest of the tree below nodes (host, final) of bounded size, whose leaves come in a row: an explicit stack, no recursion.

    Stretches that all leaves of a node share are passed at once, so work goes by branches and not by levels.
    """
    least = min(MANY + 1, EVIDENCE)

    def below(final: list[str], leaves: list[tuple]) -> Iterator[tuple]:
        todo = [(list(final), leaves)]
        while todo:
            done, rows = todo.pop()
            at = len(done)
            if len(rows) == 1 or sum(r[1] for r in rows) < least:
                yield from ((r, done + r[0][at:]) for r in rows)
                continue
            rests = [r[0][at:] for r in rows]
            done = done + rests[0][: _shared(min(rests), max(rests))]
            at = len(done)
            kids = defaultdict(list)
            for r in rows:
                if len(r[0]) == at:
                    yield r, done
                else:
                    kids[r[0][at]].append(r)
            groups = defaultdict(list)
            for seg, name in _names((k, *(sum(r[i] for r in v) for i in (1, 2, 3))) for k, v in kids.items()).items():
                groups[name] += kids[seg]
            todo += [([*done, name], v) for name, v in groups.items()]

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    out: list[tuple] = []
    for (host, final), group in groupby(rows(), key=lambda r: (r[0], r[5])):
        for (segments, n, labelled, blocked), done in below(final, [r[1:5] for r in group]):
            out.append((host, segments, n, labelled, blocked, done))
            if len(out) >= 4096:
                yield _batch(out)
                out = []
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    words = pa.list_(pa.string())
    kinds = {"host": pa.string(), "segments": words, "n": pa.int64(), "labelled": pa.int64(), "blocked": pa.int64(), "final": words}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def _rest() -> Column:
    """The segments of a leaf that `final` doesn't cover yet."""
    return F.slice("segments", F.size("final") + 1, F.greatest(F.size("segments"), F.lit(1)))


def _level(todo: DataFrame) -> DataFrame:
    """The leaves of `todo` one branching further: the stretch that all of a node's leaves share is passed, and the segment after it
    generalised or merged. Leaves that end there have the flag `ended`."""
    ends = todo.withColumn("rest", _rest()).groupBy("host", "final").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"), F.count("*").alias("n"))
    differ = F.array_position(F.zip_with("lo", "hi", lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
    ends = settle(ends.select("host", "final", "n", F.when(differ == 0, F.size("lo")).otherwise(differ - 1).cast("int").alias("shared")))
    here = salted_join(todo, ends.drop("n"), ["host", "final"], ["segments"], counts=ends)
    here = here.withColumn("final", F.concat("final", F.slice(_rest(), F.lit(1), F.col("shared")))).drop("shared")
    here = settle(here.withColumn("seg", F.get("segments", F.size("final"))))
    node = here.where("seg is not null").groupBy("host", "final", "seg").agg(F.sum("n").alias("c"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.count("*").alias("leaves"))
    node = settle(node)
    parent = node.groupBy("host", "final").agg(F.sum("c").alias("pc"), F.count("*").alias("kids"), F.sum("l").alias("pl"), F.sum("b").alias("pb"))
    judged = salted_join(node, parent, ["host", "final"], ["seg"], counts=parent.withColumnRenamed("kids", "n"))
    p = F.col("pb") / F.greatest(F.col("pl"), F.lit(1))
    z = F.abs(F.col("b") - F.col("l") * p) / F.sqrt(F.greatest(F.col("l") * p * (1 - p), F.lit(0.25)))
    variable = (F.col("kids") > MANY) & (F.col("c") < RARE * F.col("pc"))
    alike = (F.col("kids") > 1) & (F.col("l") >= EVIDENCE) & (z < SIMILAR) & ~F.col("seg").startswith("*")
    name = F.when(variable, F.lit("*")).when(alike, F.lit("*+")).otherwise(F.col("seg"))
    judged = judged.select("host", "final", "seg", name.alias("as"))
    moved = salted_join(here.where("seg is not null"), judged, ["host", "final", "seg"], ["segments"], counts=node.withColumnRenamed("leaves", "n").drop("c", "l", "b"))
    moved = moved.withColumn("final", F.concat("final", F.array("as"))).select(*_LEAF, F.lit(False).alias("ended"))
    return settle(moved.unionByName(here.where("seg is null").select(*_LEAF, F.lit(True).alias("ended"))))


def _tree(leaves: DataFrame) -> DataFrame:
    """leaves (host, segments, n, labelled, blocked) with `final`: the segments after generalising and merging.

    A node with one leaf, or with too few pages to be generalised further down, is done: children are variable only if there are
    more than MANY, and merged only with EVIDENCE labelled pages. Nodes whose leaves have TASK_CHARS characters or fewer are
    finished in one pass, however deep they are, many nodes a task. Only larger ones go branching by branching over the cluster.
    """
    least = min(MANY + 1, EVIDENCE)
    todo, done = leaves.withColumn("final", F.array().cast("array<string>")).select(*_LEAF), []
    while True:
        chars = F.length(F.array_join("segments", "/")) + 16
        nodes = settle(todo.groupBy("host", "final").agg(F.sum("n").alias("pages"), F.count("*").alias("rows"), F.sum(chars).alias("chars")))
        kind = F.when((F.col("pages") < least) | (F.col("rows") == 1), "done").when(F.col("chars") <= TASK_CHARS, "small").otherwise("large")
        tagged = settle(salted_join(todo, nodes.select("host", "final", kind.alias("kind")), ["host", "final"], ["segments"], counts=nodes.select("host", "final", F.col("rows").alias("n"))))
        done.append(tagged.where("kind = 'done'").select(*_LEAF[:-1], F.concat("final", _rest()).alias("final")))
        small = tagged.where("kind = 'small'").select(*_LEAF).repartition("host", "final").sortWithinPartitions("host", "final")
        done.append(small.mapInArrow(_finish, small.schema))
        large = tagged.where("kind = 'large'").select(*_LEAF)
        if not large.limit(1).count():
            break
        moved = _level(large)
        done.append(moved.where("ended").drop("ended"))
        todo = moved.where("not ended").drop("ended")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return settle(out)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, blocked_share) for every row of pages (page_id, url).

    A page that a rule fits has the rule's verdict. All others are blocked where their template's smoothed blocked share is
    at least REJECT, so without any labelled page all are allowed. Null and malformed urls have an empty host and path and
    are one template; repeated rows are judged alike.
    """
    host, path = host_and_path(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    base = base.select("*", rule.alias("rule"), verdict.alias("ruled"), template(F.col("path")).alias("segments"))
    labelled, blocked = F.col("ruled").isNotNull().cast("long"), F.coalesce(F.col("ruled") == "block", F.lit(False)).cast("long")
    leaves = settle(base.groupBy("host", "segments").agg(F.count("*").alias("n"), F.sum(labelled).alias("labelled"), F.sum(blocked).alias("blocked")))
    t = _tree(leaves)
    own = settle(t.groupBy("host", "final").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.count("*").alias("leaves")))
    shape = own.groupBy("final").agg(F.sum("l").alias("sl"), F.sum("b").alias("sb"), F.count("*").alias("n"))
    many = own.select("host", "final", F.col("leaves").alias("n"))
    total = own.agg(F.sum("l").alias("tl"), F.sum("b").alias("tb"))  # one row
    own = salted_join(own, shape.drop("n"), ["final"], ["host"], counts=shape).join(F.broadcast(total.withColumn("one", F.lit(1))), F.lit(1) == F.col("one"))
    over = F.col("tb") / F.greatest(F.col("tl"), F.lit(1))
    like = (F.col("sb") + WEIGHT * over) / (F.col("sl") + WEIGHT)
    own = own.select("host", "final", ((F.col("b") + WEIGHT * like) / (F.col("l") + WEIGHT)).alias("blocked_share"))
    judged = salted_join(t.select("host", "segments", "final"), own, ["host", "final"], ["segments"], counts=many)
    out = salted_join(base, judged, ["host", "segments"], ["page_id", "path"], counts=leaves)
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("blocked_share") >= REJECT, "block").otherwise("allow")).alias("verdict"), F.concat(F.lit("/"), F.array_join("final", "/")).alias("template"), "blocked_share")
