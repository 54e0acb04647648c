"""Prefix trees, periodic runs and embeddings against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry.llm import conversations, embeddings, periodic

TURNS = "conv_id long, turn long, role string, text string, source string, key string, place string"


def tree(rows, rebuild=True):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in conv.items()}
    seq = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq[c] = own.get(c - c % 100, [])[:h] + v[h:] if rebuild else v
    members, kids, leaves, saved = defaultdict(list), defaultdict(set), defaultdict(int), defaultdict(int)
    for c, s in seq.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].add(k)
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
            leaves[k[:d]] += k not in kids
    digest = lambda k, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(seq[c]) == len(k)).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids[k]), leaves[k], saved[k], digest(k, m)) for k, m in members.items())


def nodes(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def some_turns(seed):
    r = random.Random(seed)
    out = []
    for c in [*range(100, 140), *r.sample(range(200, 900), 40), 300, 400]:
        out += [(c, t, r.choice(["user", None]), r.choice(["a", "bb", "", None, "çé"]) if r.random() < 0.7 else f"own {c} {t}") for t in range(r.choice([1, 1, 2, 3, 6, 9]))]
    out += [(700, None, "user", "no number"), (None, 1, "user", "no conversation"), (101, 0, "user", "a"), (101, 0, "user", "a")]
    return out


@pytest.mark.parametrize(("seed", "size"), [(1, 1 << 16), (2, 20), (3, 4)])
def test_tree(spark, seed, size):
    """Whole trees; small ranges put neighbours of one path into many tasks."""
    numbered = {}
    for c, t, r, x in some_turns(seed):  # one turn a number: what equal numbers give isn't fixed
        numbered.setdefault((c, t), (c, t, r, x))
    rows = list(numbered.values())
    df = spark.createDataFrame([(*x, "s", "k", "p") for x in rows], TURNS).repartition(5)
    c = F.col("conv_id")
    seqs = conversations.rebuilt(conversations.sequences(df), c - c % 100, F.crc32(c.cast("string").cast("binary")) % 6, 5)
    assert nodes(conversations.prefix_tree(seqs, size)) == tree(rows)
    if size == 20:
        assert nodes(conversations.conversation_tree(df)) == tree(rows)


def test_tree_of_copies_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK_IDS", 7)
    rows = [(c, t, "user", f"turn {t}") for c in range(1, 300) for t in range(3)] + [(5000, 0, "user", "turn 0"), (5000, 0, "user", "turn 0")]
    df = spark.createDataFrame([(*x, "s", "k", "p") for x in rows], TURNS)
    assert nodes(conversations.prefix_tree(conversations.sequences(df), 10)) == tree(rows, rebuild=False)
    assert conversations.conversation_tree(df.limit(0)).collect() == []


def runs_of(w):
    n, out = len(w), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            s = w[i : j + p]
            if j > i and len(s) >= max(12, 2 * p) and all(any(s[k] != s[k + q] for k in range(len(s) - q)) for q in range(1, p)):
                out.add((i, len(s), p))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def summary(d, text, rewrite):
    w = [x for x in (text or "").translate({i: " " for i in range(9, 14)}).split(" ") if x]
    h = zlib.crc32(str(d).encode())
    if rewrite and d is not None and h % 10 == 0 and w:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(len(w))]
    runs = runs_of(w)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (d, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def periodic_rows():
    r = random.Random(7)
    texts = [None, "", " \t\n", "one", "a " * 40, "a b " * 6, "a b c " * 4 + "a", "x y " * 15, "é è " * 9 + "tail"]
    for _ in range(60):
        w = [r.choice("abcdefgh"[: r.choice([1, 2, 8])]) for _ in range(r.choice([5, 30, 90]))]
        if r.random() < 0.5:
            q = r.randint(1, 30)
            w = w[:10] + (w[:q] * 99)[: r.randint(1, 80)] + w[10:]
        texts.append(r.choice([" ", "\n", "  "]).join(w))
    out = [(i * 3, t, "en", "s", 0, "b", "l", "x") for i, t in enumerate(texts)]
    return [*out, out[10], (None, "no id " * 9, None, None, None, None, None, None)]


@pytest.mark.parametrize("long_chars", [1 << 16, 40])
def test_runs(spark, long_chars):
    """With 40 characters most texts' lags are dealt over several tasks."""
    rows = periodic_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, mark string, runs string, share string").repartition(3)
    for rewrite in (False, True):
        got = [tuple(r) for r in periodic.periodic_runs(df, rewrite, long_chars).collect()]
        assert sorted(got, key=repr) == sorted((summary(x[0], x[1], rewrite) for x in rows), key=repr)
    assert sum(g[1] > 0 for g in got) > 20 and periodic.periodic_runs(df.limit(0)).collect() == []


def test_scan_of_a_long_text():
    w = ([b"a", b"b", b"c"] * 3000 + [b"x"] + [str(i % 700).encode() for i in range(30_000)])[:40_000]
    a, first = periodic.word_ids([w])
    assert periodic.merged(periodic.scan(a, first, range(1, 20_001)))[:, 1:].tolist() == [[0, 9000, 3], [9001, 30_000, 700]]


def test_bounds_are_rigorous():
    r = np.random.default_rng(3)
    for width in (1, 2, 64, 1500):
        u, codes, scale, bound = embeddings.quantised(r.standard_t(2, (200, width)) * 10.0 ** r.integers(-8, 8, (200, 1)))
        exact, near = u @ u.T, (codes * scale[:, None]) @ (codes * scale[:, None]).T
        assert (abs(exact - near) <= bound[:, None] + bound + bound[:, None] * bound + 1e-9).all()


def vectors():
    r = np.random.default_rng(11)
    out, x = [], r.normal(size=(40, 24))
    for i in range(40):
        out.append(x[i].tolist())
        for _ in range(r.integers(0, 4)):
            out.append((x[i] + r.normal(size=24) * r.choice([0.05, 0.25, 0.33, 0.4])).tolist())
    chain = [np.cos(k * 0.4) * x[0] / np.linalg.norm(x[0]) + np.sin(k * 0.4) * x[1] / np.linalg.norm(x[1]) for k in range(12)]
    out += [(c * 1e5).tolist() for c in chain] + [out[0], out[0], [2 * v for v in out[3]]]
    out += [None, [], [0.0] * 24, [1.0] * 23 + [None], [1.0] * 23 + [float("nan")], [1.0] * 23 + [float("inf")], [-0.0] * 23 + [2.0], [0.0] * 23 + [1.0], [1.0], [-3.0], [2.0], x[0][:10].tolist(), x[0][:10].tolist()]
    ids = r.permutation(len(out)) * 7 + 2
    rows = [(int(i), v) for i, v in zip(ids, out, strict=True)]
    return [*rows, rows[5], rows[5], (None, out[0]), (None, None)]


@pytest.mark.parametrize(("block", "pivots"), [(8192, 64), (9, 5)])
def test_embeddings(spark, block, pivots):
    rows = vectors()
    fine = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    cosine = lambda a, b: len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.9
    links = {i: {j for j in fine if j != i and cosine(fine[i], fine[j])} if i in fine else set() for i, _ in rows}
    want = []
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        low = min(seen) if i is not None else None
        want.append((i, len(links[i]), low, i == low))
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, label int, rep string, vec string").repartition(3)
    assert sorted(map(tuple, embeddings.near_embeddings(df, 0.9, block=block, pivots=pivots).collect()), key=repr) == sorted(want, key=repr)
    assert max(n for _, n, _, _ in want) > 4 and any(n == 1 for _, n, _, _ in want)


def test_only_doubtful_pairs_are_computed_anew(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(600, 64))
    x[300:] = x[:300] + r.normal(size=(300, 64)) * 0.2
    df = spark.createDataFrame([(i, i + 1, i, 1, v) for i, v in enumerate(x.tolist())], "d0 long, d1 long, rep long, copies long, vec array<double>")
    got = embeddings.class_links(df, 0.9).agg(F.sum("recomputed"), F.sum("n_links")).first()
    assert got[1] >= 600 and got[0] < 1000


def test_no_vectors_and_one_id_with_two(spark):
    kind = "vec_id long, embedding array<float>"
    assert embeddings.near_embeddings(spark.createDataFrame([], kind)).collect() == []
    got = embeddings.near_embeddings(spark.createDataFrame([(4, [1.0, 0.0]), (4, [0.0, 1.0]), (2, [1.0, 0.1]), (9, [0.0, 1.0])], kind))
    assert sorted(map(tuple, got.collect())) == [(2, 1, 2, True), (4, 1, 2, False), (4, 1, 2, False), (9, 1, 2, False)]
