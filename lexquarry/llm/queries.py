"""The thin queries over the driver's tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, conversations, embeddings, fingerprints, language, minhash, periodic, pii, secrets, substrings, toxicity, urls
from ._base import table
from .packing import pack

WHITE = r"[^\x20\x09-\x0D]+"


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85).drop("class_id")


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), _remainder(3) != 1)
    got = toxicity.score(docs, model)
    return got.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(table(spark, sf_dir, "documents")).drop("removed")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, _remainder(5) != 0)
    return language.identify(docs, model).select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score")


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversation_tree(table(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(table(spark, sf_dir, "documents"), rewrite=True)


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_embeddings(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_document_fingerprints, op2_minhash_near_dedup, op3_toxicity, op4_substring_dedup, op5_secret_scans, op6_benchmark_decontamination, op7_language_id, op8_pii_surrogates, op9_best_fit_packing, op10_url_filters, op11_conversation_prefix_trie, op12_periodic_runs, op13_embedding_near_dedup)}


#: Words of the window tables below: lower-cased A-Z, as lists.
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"

_OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM benchmark WHERE item_id IS NOT NULL),
wi AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wi),
wd AS (SELECT r, s, n, array_to_string(w[s : s + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT wd.r, wd.s, wd.n, wi.item FROM wd JOIN wi ON wd.n = wi.n AND wd.g = wi.g),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM m)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


_OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, s, array_to_string(w[s : s + 12], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
lo AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(s, s + 13)) AS p FROM win JOIN lo USING (g) WHERE lo.m < win.doc_id)),
ps AS (SELECT r, list(p) AS ps FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ps, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN ps USING (r)
"""


_LEAVES = "CASE WHEN p = '' THEN [''] ELSE regexp_extract_all(p, '(?s).{0,254}?[.!?] |.{1,256}') END"


def _tree(v: str) -> str:
    return f"list_transform(string_split({v}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform({_LEAVES}, lambda x: md5(x))))"


def _fingerprint(t: str, s: str) -> str:
    return f"sha256(array_to_string({s}, '')) || ':' || array_to_string(list_transform({s}, lambda x: left(x, 16)), '') || ':' || array_to_string({t}, '')"


def _likeness(a: str, b: str) -> str:
    return f"2.0 * len(list_intersect({a}, {b})) / (len(list_distinct({a})) + len(list_distinct({b})))"


_SECTIONS = "list_transform({0}, lambda s: sha256(array_to_string(list_transform(s, lambda p: sha256(array_to_string(p, ''))), '')))"
_TAGS = "list_transform(flatten(flatten({0})), lambda x: left(x, 8))"
_OP1 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
e AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nxt FROM d),
f AS (SELECT doc_id, n, t, nxt, left(t, n - n // 2) || left(nxt, n // 2) AS et FROM e),
g AS (SELECT doc_id, n, et, {_tree('t')} AS a, {_tree('et')} AS b, {_tree('nxt')} AS c FROM f),
h AS (SELECT doc_id, n, et, {_SECTIONS.format('a')} AS sa, {_TAGS.format('a')} AS ta, {_SECTIONS.format('b')} AS sb, {_TAGS.format('b')} AS tb, {_TAGS.format('c')} AS tc FROM g)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(et) AS edited_sha256, {_fingerprint('ta', 'sa')} AS fingerprint, {_fingerprint('tb', 'sb')} AS edited_fingerprint,
  CAST({_likeness('ta', 'tb')} AS DOUBLE) AS near_edited, CAST({_likeness('ta', 'tc')} AS DOUBLE) AS near_next FROM h
"""

_OP2 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(r'[^\x20\x09-\x0D]+')} AS w FROM documents),
sh AS (SELECT DISTINCT r, doc_id, g FROM (
  SELECT r, doc_id, array_to_string(w[s : s + 2], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM d WHERE len(w) >= 3)
  UNION ALL SELECT r, doc_id, array_to_string(w, ' ') FROM d WHERE len(w) IN (1, 2))),
n AS (SELECT r, doc_id, count(*) AS n FROM sh GROUP BY r, doc_id),
p AS (SELECT a.r AS ra, b.r AS rb, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM p JOIN n x ON x.r = p.ra JOIN n y ON y.r = p.rb WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d LEFT JOIN n ON n.r = d.r JOIN c ON c.a = d.doc_id
"""


# The CRC-32 of an id's decimal digits, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT)), lambda acc, ch: list_reduce(list_prepend(xor(acc, ch), range(8)), lambda s, k: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END)), 4294967295::BIGINT)"

_OP11 = f"""
WITH t AS (SELECT conv_id AS c, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(g ORDER BY turn NULLS FIRST, g) AS g, list(n ORDER BY turn NULLS FIRST, g) AS n, ({_CRC.format("c::VARCHAR")} % 6)::INT AS h FROM t GROUP BY c),
seq AS (SELECT o.c, coalesce(b.g, [])[1 : o.h] || o.g[o.h + 1 :] AS g, coalesce(b.n, [])[1 : o.h] || o.n[o.h + 1 :] AS n FROM own o LEFT JOIN own b ON b.c = o.c - o.c % 100),
pre AS (SELECT c, d, array_to_string(g[1 : d], '') AS p, CASE WHEN d > 0 THEN array_to_string(g[1 : d - 1], '') END AS up, CASE WHEN d > 0 THEN n[d] ELSE 0 END AS chars, d = len(g) AS at_end FROM (SELECT c, g, n, unnest(range(len(g) + 1)) AS d FROM seq)),
node AS (SELECT d, p, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (at_end), '')) AS ends_sha256 FROM pre GROUP BY d, p),
kids AS (SELECT d - 1 AS d, up AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2),
whole AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (d, p)),
sums AS (SELECT a.d, a.p, sum((b.n_convs - 1) * b.chars) AS saved, count(*) FILTER (b.n_children = 0) AS n_leaves FROM whole a JOIN (SELECT w.*, unnest(range(w.d + 1)) AS over FROM whole w) b ON b.over = a.d AND left(b.p, 32 * a.d) = a.p GROUP BY 1, 2)
SELECT w.conv_id, w.d::BIGINT AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, w.ends_sha256
FROM whole w JOIN sums s USING (d, p) LEFT JOIN node u ON u.d = w.d - 1 AND u.p = w.up
"""

_OP13 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
f AS (SELECT vec_id, x FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_document_fingerprints": _OP1, "op2_minhash_near_dedup": _OP2, "op4_substring_dedup": _OP4, "op6_benchmark_decontamination": _OP6, "op11_conversation_prefix_trie": _OP11, "op13_embedding_near_dedup": _OP13}
