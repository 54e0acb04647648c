"""MinHash groups and substring removal against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexquarry.llm import _base, minhash, substrings
from lexquarry.llm._base import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(t)
    return set() if not w else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def brute_groups(rows, k, percent):
    sets = [(r[0], shingles(r[1], k)) for r in rows if r[0] is not None]
    comp = {i: i for i, _ in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(i), root(j)
                comp[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80), (1, 60)])
def test_groups_equal_brute_force(docs, rows, k, percent):
    want = brute_groups(rows, k, percent)
    got = minhash.near_duplicates(docs, k=k, percent=percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_chain_that_misses_the_centre(spark):
    """Members that link only to each other, and not to their bucket's smallest member, are still joined."""
    base = [f"w{i}" for i in range(400)]

    def edit(words, at):
        return [f"e{at}_{i}" if at <= i < at + 24 else w for i, w in enumerate(words)]

    texts = [base, edit(base, 0), edit(edit(base, 0), 100), edit(edit(edit(base, 0), 100), 200), edit(edit(edit(edit(base, 0), 100), 200), 300)]
    rows = [(i + 1, " ".join(t)) for i, t in enumerate(texts)]
    want = brute_groups(rows, 3, 85)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_blocks_find_all_links(spark, monkeypatch):
    """With tiny blocks a group is compared across block pairs; links between components are all found."""
    monkeypatch.setattr(minhash, "BLOCK", 2)
    base = [f"w{i}" for i in range(300)]
    rows = [(n, " ".join(f"x{n}_{i}" if n * 9 <= i < n * 9 + 9 else w for i, w in enumerate(base))) for n in range(1, 12)]
    want = brute_groups(rows, 3, 85)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_texts_move_once_for_both_sides_of_pairs(spark):
    """op2: the texts of both sides were moved apart."""
    rows = [(i, f"a b c d e {i // 2}") for i in range(6)]
    pairs = spark.createDataFrame([(1, 0), (2, 0), (5, 4)], "a long, b long")
    got = minhash._confirm(pairs, spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 2  # the same rows by the same key: made once
    assert sorted(map(tuple, got.collect())) == [(1, 0), (5, 4)]


def test_densified_bins_keep_likeness():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64))
    b = a[:-6]
    same = (minhash.sketches([a]) == minhash.sketches([b])).mean()
    assert abs(same - len(b) / len(a)) < 0.15
    assert (minhash.sketches([a[:1]]) == minhash.sketches([a[:1]])).all()


def test_no_documents(none):
    assert minhash.near_duplicates(none).count() == 0
    assert substrings.repeats(none).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in range(100, 140)} == {100}


@pytest.mark.parametrize("few", [0, 100])
def test_components_of_few_and_many_edges(spark, monkeypatch, few):
    """op2: a few thousand edges went to all partitions several times a round, hundreds of files each."""
    monkeypatch.setattr(_base, "FEW_EDGES", few)
    plans = []
    monkeypatch.setattr(_base, "settle", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df.checkpoint(eager=True))
    edges = [(i, i + 1) for i in range(1, 40)] + [(90, i) for i in range(91, 99)] + [(98, 70), (7, 7), (2**40, -5), (3, 4)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 70 for i in [70, *range(90, 99)]}, 2**40: -5, -5: -5}
    assert len(plans) > 2 and all(("hashpartitioning" in p) == (few == 0) for p in plans[1:])


def brute_repeats(rows, n=13):
    words = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    key = lambda i: 2**63 if i is None else i
    first = {}
    for i, w in words:
        for s in range(len(w) - n + 1):
            g = tuple(w[s : s + n])
            first[g] = min(first.get(g, 2**63), key(i))
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] < key(i):
                gone.update(range(s, s + n))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("blocks", [None, 1, 7])
def test_removed_words_equal_brute_force(docs, rows, blocks):
    got = substrings.repeats(docs, blocks=blocks)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()) == brute_repeats(rows)


def test_nothing_repeats(spark):
    rows = [(1, "short"), (2, " ".join(f"a{i}" for i in range(50))), (3, " ".join(f"b{i}" for i in range(50))), (4, None)]
    for blocks in (1, 9):
        got = substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string"), blocks=blocks).collect()
        assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == [(1, 1, 0), (2, 50, 0), (3, 50, 0), (4, 0, 0)]


def test_removed_spans_are_maximal(docs):
    for r in substrings.repeats(docs).collect():
        spans = [(s["start"], s["end"]) for s in r["removed"]]
        assert sum(e - s for s, e in spans) == r["n_removed"]
        assert all(e - s >= 13 for s, e in spans) and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def hot_rows(n):
    """A short line that all documents hold between other words, and the same with more of its surroundings in some."""
    import random

    r = random.Random(8)
    line = "this line of nine words is in all documents".split()
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    more = [[word() for _ in range(8)] + line + [word() for _ in range(8)] for _ in range(5)]
    rows = [(i, " ".join([*(word() for _ in range(15)), *(line if r.random() < 0.7 else r.choice(more)), *(word() for _ in range(15))])) for i in range(n)]
    return [*rows, rows[3], (None, rows[5][1]), (n, " ".join(["same"] * 40)), (n + 1, " ".join(["same"] * 60))]


@pytest.mark.parametrize("hot", [0, 30, 10**9])
def test_hot_anchors_equal_brute_force(spark, hot):
    rows = hot_rows(120)
    got = substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string"), blocks=5, hot=hot)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()) == brute_repeats(rows)


def test_hot_anchors_spread_over_shards():
    """Windows of one anchor between other words meet in no shard, and copies of one document make nothing hot."""
    import pyarrow as pa

    def sent(rows, hot):
        """Hot anchors, and the most distinct passages that must meet in one shard."""
        blocks = [substrings._Block(pa.table({"doc_id": [x[0] for x in part], "text": [x[1] for x in part]}), 13) for part in (rows[i::8] for i in range(8))]
        u = [np.unique(b.anchor) for b in blocks]
        notes = [substrings._notes(b.anchor, b.grams(13), np.array([len(set(b.doc[b.anchor == a])) > 1 for a in x])) for b, x in zip(blocks, u, strict=True)]
        ok, much = substrings._judge(np.concatenate(u), np.concatenate(notes), hot)
        a = np.concatenate(u)
        meet = set()
        for b in blocks:
            _, _, anchor, h = b.passages(np.unique(a[ok]), np.unique(a[much]), 13)
            meet |= set(zip(anchor.tolist(), h.tolist(), strict=True))
        return len(np.unique(a[much])), max(Counter(k for k, _ in meet).values())

    rows = [x for x in hot_rows(800) if x[0] is not None][:800]
    n, most = sent(rows, 400)
    assert n > 0 and most <= 400
    n, most = sent(rows, 10**9)
    assert n == 0 and most > 400
    assert sent([(i, rows[0][1]) for i in range(800)], 100)[0] == 0


def test_automaton_against_substrings():
    import random

    r = random.Random(2)
    texts = [[bytes([97 + r.randrange(2)]) for _ in range(r.randrange(5, 25))] for _ in range(20)]
    m = substrings.Automaton()
    for d, t in enumerate(texts):
        m.add(t, d)
    first = defaultdict(lambda: -1)
    for d, t in reversed(list(enumerate(texts))):
        for s in range(len(t) - 3):
            first[tuple(t[s : s + 4])] = d
    for q in [*texts, [b"a", b"b"] * 10, [b"z"] * 6]:
        assert m.first_docs(q, 4) == [first[tuple(q[s : s + 4])] for s in range(len(q) - 3)]


def test_messages_grow_with_the_input():
    """op4: blocks and shards grew with the input, so that their messages, one for each pair, grew with its square; and no automaton has more than some anchors."""
    for chars in (10**9, 10**10, 10**12):
        (a, b), (c, d) = substrings._sizes(chars), substrings._sizes(5 * chars)
        assert 4.9 < c * d / (a * b) < 5.1 and a * b <= chars // 3_900
    assert substrings._sizes(0) == (1, 1) and substrings._sizes(0, 7) == (7, 3)


@pytest.mark.parametrize("words", [1, 10, 100])
def test_automata_of_some_anchors(monkeypatch, words):
    monkeypatch.setattr(substrings, "AUTOMATON_WORDS", words)
    known = {b"a b c": [5, 1], b"b c d": [3, 1], b"x y z": [2, 2], b"q r s": [4, 3], b"q r s t": [9, 3], b"u v": [7, 4]}
    want = {b"a b c": [5, 3], b"b c d": [3, 3], b"x y z": [2, 2], b"q r s": [4, 4], b"q r s t": [4, 4, 9], b"u v": [7]}
    assert substrings._first_docs(known, 2) == want and substrings._first_docs({}, 2) == {}
