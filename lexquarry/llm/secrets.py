"""Secret scans: known formats, and strings that a battery of randomness tests can't tell from random ones.

Every long run of encoded characters is taken for hexadecimal, base32, base36 or base64 by the characters it uses. Three tests
follow, each a standard score under "uniform and independent": chi-squared of the characters' counts, runs of character
classes, and serial correlation. Their combination gives a p-value. Text-like runs crowd near 0, random ones spread evenly;
so in each class of encoding and length, the runs above 1/2 estimate how many are random, and the least threshold whose
excess over that estimate stays below the allowed false share decides. All of it is native expressions; only a table of
encodings x lengths x 20 bins is gathered from the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import let, running, salted_join, settle

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_-]{20,}+={0,2}"
#: No kind of secret is in a text without a match of this: known keys are long runs as well.
SUSPECT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20}"""
KINDS = ["assign", "access", "hex", "random"]
#: False share that each class of runs may hold, bins of the p-values, and the estimated random runs that a class needs for a
#: threshold of its own; with fewer it takes its encoding's, and without one there the upper half, which the estimate takes for random.
FALSE_SHARE, BINS, LEAST_RANDOM = 0.1, 20, 4
#: Characters of a piece of text from which parts are taken, so that no part costs a pass over the whole text.
PIECE = 1024


def spans(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: array<struct<start, end, value>>, in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def placed(m: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), lambda g: F.length(g))
        steps = F.zip_with(gaps, m, lambda g, x: g + F.length(x))
        at = lambda z: z["p"] + z["g"]
        whole = F.arrays_zip(running(steps, F.lit(0), lambda x, y: x + y).alias("p"), gaps.alias("g"), m.alias("m"))
        return F.transform(whole, lambda z: F.struct(at(z).alias("start"), (at(z) + F.length(z["m"])).alias("end"), z["m"].alias("value")))

    return let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(placed(m)))


def base_spans(text: Column) -> dict[str, Column]:
    assign = F.filter(spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6)
    return {"assign": assign, "access": spans(text, ACCESS), "hex": spans(text, HEX)}


def battery(value: Column) -> dict[str, Column]:
    """Encoding, length class and the three standard scores of a run of characters, without trailing padding."""
    v = F.rtrim(value, F.lit("="))
    n = F.length(v).cast("double")
    kind = F.when(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(v.rlike("^[A-Z2-7]+$"), "base32").when(v.rlike("^(?:[0-9a-z]+|[0-9A-Z]+)$"), "base36").otherwise("base64")
    return {"v": v, "n": n, "encoding": kind}


def _scores(runs: DataFrame) -> DataFrame:
    """Adds p: the combined p-value of the battery for column `value`."""
    b = battery(F.col("value"))
    runs = runs.withColumns(b).withColumn("chars", F.split("v", ""))
    size = F.expr("CASE encoding WHEN 'hex' THEN 16.0D WHEN 'base32' THEN 32.0D WHEN 'base36' THEN 36.0D ELSE 64.0D END")
    count = F.transform(F.array_distinct("chars"), lambda c: F.pow(F.size(F.filter("chars", lambda x: x == c)).cast("double"), F.lit(2.0)))
    squares = F.aggregate(count, F.lit(0.0), lambda a, x: a + x)
    runs = runs.withColumn("k", size).withColumn("squares", squares)
    chi = F.col("k") * F.col("squares") / F.col("n") - F.col("n")
    z_chi = (chi - (F.col("k") - 1)) / F.sqrt(2 * (F.col("k") - 1) * (F.col("n") - 1) / F.col("n"))
    # Classes of characters: digits, lower and upper case, others. `same` is the chance that two random neighbours agree.
    classes = F.split(F.translate("v", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-", "a" * 26 + "A" * 26 + "0" * 10 + "++++"), "")
    changes = F.size(F.filter(F.arrays_zip(F.slice(classes, F.lit(1), F.col("n").cast("int") - 1).alias("x"), F.slice(classes, F.lit(2), F.col("n").cast("int")).alias("y")), lambda z: z["x"] != z["y"])).cast("double")
    same = F.expr("CASE encoding WHEN 'hex' THEN (100.0D + 36) / 256 WHEN 'base32' THEN (676.0D + 36) / 1024 WHEN 'base36' THEN (676.0D + 100) / 1296 ELSE (676.0D + 676 + 100 + 4) / 4096 END")
    m = F.col("n") - 1
    z_runs = (changes - m * (1 - same)) / F.sqrt(m * same * (1 - same))
    codes = F.transform("chars", lambda c: F.ascii(c).cast("double"))
    runs = runs.withColumn("codes", codes).withColumn("mean", F.aggregate(codes, F.lit(0.0), lambda a, x: a + x) / F.col("n"))
    spread = F.aggregate("codes", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))
    lag = F.aggregate(F.arrays_zip(F.slice("codes", F.lit(1), F.col("n").cast("int") - 1).alias("x"), F.slice("codes", F.lit(2), F.col("n").cast("int")).alias("y")), F.lit(0.0), lambda a, z: a + (z["x"] - F.col("mean")) * (z["y"] - F.col("mean")))
    z_serial = F.coalesce(F.try_divide(lag, spread), F.lit(1.0)) * F.sqrt(F.col("n"))
    tail = lambda z: 1 / (1 + F.exp(F.least(F.lit(700.0), 1.702 * z)))  # noqa: E731  the normal tail, by its logistic approximation
    # Fisher's combination of the upper chi-squared tail and the two-sided tails of the others.
    x = -F.log(F.greatest(tail(z_chi), F.lit(1e-12))) - F.log(F.greatest(F.least(2 * tail(F.abs(z_runs)), F.lit(1.0)), F.lit(1e-12))) - F.log(F.greatest(F.least(2 * tail(F.abs(z_serial)), F.lit(1.0)), F.lit(1e-12)))
    return runs.withColumn("x", x).withColumn("p", F.exp(-F.col("x")) * (1 + F.col("x") + F.col("x") * F.col("x") / 2)).drop("chars", "codes", "mean", "k", "squares", "x", "v")


def _length_class(n: Column) -> Column:
    return F.when(n < 24, 0).when(n < 32, 1).when(n < 40, 2).when(n < 64, 3).when(n < 128, 4).otherwise(5)


def thresholds(scored: DataFrame) -> DataFrame:
    """(encoding, length_class, least_bin): the least bin of p that holds at most FALSE_SHARE runs beyond the estimated random ones.
    length_class -1 holds an encoding's runs of all lengths, for the classes that have too few."""
    by = ["encoding", "length_class"]
    each = scored.withColumn("length_class", F.explode(F.array("length_class", F.lit(-1))))
    bins = each.groupBy(*by, F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.count("*").alias("c"))
    above = bins.withColumn("above", F.sum("c").over(Window.partitionBy(*by).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)))
    above = above.withColumn("random", 2.0 * F.coalesce(F.sum(F.when(F.col("bin") >= BINS // 2, F.col("c"))).over(Window.partitionBy(*by)), F.lit(0)))
    excess = (F.col("above") - (1 - F.col("bin") / BINS) * F.col("random")) / F.col("above")
    return above.where((F.col("random") >= LEAST_RANDOM) & (excess <= FALSE_SHARE)).groupBy(*by).agg(F.min("bin").alias("least_bin"))


def _free(runs: Column, known: Column) -> Column:
    """The runs that overlap no known span, found in one sweep over both in the order of their starts."""
    event = lambda is_run: lambda s: F.struct(s["start"].alias("start"), F.lit(is_run).alias("is_run"), s["end"].alias("end"), (s["value"] if is_run else F.lit("")).alias("value"))
    events = F.array_sort(F.concat(F.transform(known, event(0)), F.transform(runs, event(1))))

    def sweep(e: Column) -> Column:
        never = F.lit(2**31 - 1)
        ended = running(F.transform(e, lambda s: F.when(s["is_run"] == 0, s["end"]).otherwise(-1)), F.lit(-1), lambda x, y: F.greatest(x, y))
        after = F.reverse(running(F.transform(F.reverse(e), lambda s: F.when(s["is_run"] == 0, s["start"]).otherwise(never)), never, lambda x, y: F.least(x, y)))
        kept = F.filter(F.arrays_zip(e.alias("e"), ended.alias("x"), after.alias("y")), lambda z: (z["e"]["is_run"] == 1) & (z["x"] <= z["e"]["start"]) & (z["y"] >= z["e"]["end"]))
        return F.transform(kept, lambda z: F.struct(z["e"]["start"].alias("start"), z["e"]["end"].alias("end"), z["e"]["value"].alias("value")))

    return F.when((F.size(runs) == 0) | (F.size(known) == 0), runs).otherwise(let(events, sweep))


def scan(docs: DataFrame) -> DataFrame:
    """Adds to docs (doc_id, text, ...) the spans of known formats and `runs`, the free long runs, with `run_key` for those that have any.

    Null and empty texts hold nothing; repeated rows are scanned one by one. A run counts only where no known format overlaps it.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("*", *[c.alias(k) for k, c in base_spans(text).items()], spans(text, RUN).alias("runs"))
    return docs.withColumn("runs", _free(F.col("runs"), F.concat("assign", "access", "hex"))).withColumn("run_key", F.when(F.size("runs") > 0, F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.xxhash64("runs").alias("hash"))))


def random_runs(found: DataFrame) -> DataFrame:
    """(run_key, random: array<struct<start, end>>) of the rows of scan() that hold random runs. Equal runs are tested once."""
    runs = settle(found.where("run_key is not null").select("run_key", F.explode("runs").alias("r")).select("run_key", "r.*").distinct())
    scored = settle(_scores(runs.select("value").distinct()).withColumn("length_class", _length_class(F.col("n"))))
    limits = settle(thresholds(scored))  # encodings x length classes: at most 28 rows
    pooled = limits.where("length_class = -1").select("encoding", F.col("least_bin").alias("pooled_bin"))
    judged = scored.join(F.broadcast(limits), ["encoding", "length_class"], "left").join(F.broadcast(pooled), "encoding", "left")
    chosen = judged.where(F.floor(F.col("p") * BINS) >= F.coalesce("least_bin", "pooled_bin", F.lit(BINS // 2))).select("value")
    hits = salted_join(runs, chosen, ["value"], ["run_key"])
    return hits.groupBy("run_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("random"))


def _row(kind: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def _render(a: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(a), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _with_random(found: DataFrame) -> DataFrame:
    """Adds `random` to the rows of scan(). Only rows with runs are joined; all others would share one null key."""
    plain = found.where("run_key is null").withColumn("random", F.array().cast("array<struct<start:int,end:int>>"))
    mixed = found.where("run_key is not null").join(random_runs(found.select("runs", "run_key")), "run_key", "left")
    return plain.unionByName(mixed.select(plain.columns))


def _suspects(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that may hold secrets, and all others, told apart by one cheap pattern."""
    suspect = F.coalesce("text", F.lit("")).rlike(SUSPECT)
    return docs.where(suspect), docs.where(~suspect)


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans): `base` and `spans` list kind:start:end in the order of starts, then of
    KINDS, comma-joined; spans adds the random runs."""
    some, plain = _suspects(docs.select("doc_id", "text"))
    found = _with_random(settle(scan(some).drop("text")))
    base = F.concat(*[F.transform(k, _row(i)) for i, k in enumerate(KINDS[:3])])
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    extra = F.coalesce(F.transform("random", _row(3)), none)
    found = found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], _render(base).alias("base"), _render(F.concat(base, extra)).alias("spans"))
    return plain.select("doc_id", *[F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.lit("").alias("base"), F.lit("").alias("spans")).unionByName(found)


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The rows of docs, all columns, with every secret's span in `text` replaced by `mask`; overlapping spans become one mask."""
    columns = docs.columns
    some, plain = _suspects(docs)
    found = _with_random(settle(scan(some.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("doc_id"), F.col("text")))))
    span = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    all_spans = F.array_sort(F.concat(*[F.transform(k, span) for k in KINDS[:3]], F.coalesce("random", F.array().cast("array<struct<start:int,end:int>>"))))
    found = found.withColumn("all_spans", all_spans)
    clean = let(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda pieces: let(F.col("all_spans"), lambda s: _masked(pieces, s, F.lit(mask))))
    found = found.withColumn("clean", F.when((F.size("all_spans") == 0) | F.col("text").isNull(), F.col("text")).otherwise(clean))
    return plain.unionByName(found.select(*[F.col("clean").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in columns]))


def _masked(pieces: Column, s: Column, mask: Column) -> Column:
    """The text, given in pieces of PIECE characters, with `mask` for each run of overlapping spans of s (sorted)."""

    def part(lo: Column, hi: Column | None) -> Column:
        first = F.floor(lo / PIECE).cast("int")
        n = F.size(pieces) if hi is None else F.floor((F.greatest(hi, lo) - 1) / PIECE).cast("int") - first + 1
        joined = F.array_join(F.slice(pieces, first + 1, F.greatest(n, F.lit(0))), "")
        return F.substring(joined, lo % PIECE + 1, F.lit(2**31 - 1) if hi is None else F.greatest(hi - lo, F.lit(0)))

    def rebuilt(done: Column) -> Column:
        each = F.zip_with(s, done, lambda x, at: F.when(x["start"] < at, "").otherwise(F.concat(part(at, x["start"]), mask)))
        return F.concat(F.array_join(each, ""), part(F.array_max(F.transform(s, lambda x: x["end"])), None))

    return let(running(F.transform(s, lambda x: x["end"]), F.lit(0), lambda x, y: F.greatest(x, y)), rebuilt)
