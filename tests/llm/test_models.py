"""Learned operators: exactness of the index, parsing by automata, held-out accuracy."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry.llm import contamination, language, toxicity
from lexquarry.llm._words import PLAIN, SPACED, Words, shingle_sets


def test_words_of_any_bytes():
    texts = ["A b\tc\n\x0bd e", None, "", "ünï x1-y2", "z" * 300, " "]
    w = Words(texts, SPACED, False)
    assert w.counts().tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    p = Words(texts, PLAIN, True)
    assert p.counts().tolist() == [len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t in texts]
    same = Words(["aa bb aa"], SPACED, True).hash
    assert same[0] == same[2] != same[1]
    assert [len(s) for s in shingle_sets(Words(["a b c a b c", "a b", ""], SPACED, True), 3)] == [3, 1, 0]


def test_pieces_do_not_change_hashes(monkeypatch):
    from lexquarry.llm import _words

    texts = ["word%d other " % i * 50 for i in range(20)]
    whole = Words(texts, SPACED, True).hash
    monkeypatch.setattr(_words, "PIECE", 64)
    assert (Words(texts, SPACED, True).hash == whole).all()


def toxic_rows(n=400):
    r = random.Random(3)
    syl = ["tion", "er", "on", "the", "and", "ou", "st", "wh"]
    word = lambda: "".join(r.choices(syl, k=r.randint(1, 3)))
    out = []
    for i in range(n):
        ws = [word() for _ in range(r.randint(20, 200))]
        bad = r.random() < 0.3
        if bad:
            for _ in range(max(2, len(ws) // 20)):
                ws[r.randrange(len(ws))] = r.choice(["grobble", "snarf", "vexlat" + word(), "vexlat" + word()])
        out.append((i, " ".join(ws), int(bad)))
    return out


def test_toxicity_held_out_and_exact_neighbours(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (0, rows[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 3 != 1)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(got[i]["score"], y) for i, _, y in rows if i % 3 == 1]
    assert all((s >= 0.7) == (y == 1) for s, y in held)
    assert got[1000]["score"] == got[1001]["score"] == model.base_rate and got[1000]["evidence"] == []
    assert all(0 <= got[i]["score"] <= 1 for i in got)


def term_counts(text):
    """A text's terms in plain Python: words, and the first 4 and 5 bytes of longer ones."""
    words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    return Counter([*words, *((k, w[:k]) for w in words for k in (4, 5) if len(w) > k)])


@pytest.mark.parametrize(("least_chi", "block"), [(0.0, 64), (0.0, 8), (toxicity.LEAST_CHI, 8)])
def test_neighbours_equal_all_cosines(monkeypatch, least_chi, block):
    """The nearest examples by the block-max index, against cosines of all examples over plain dictionaries."""
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rows = toxic_rows()
    sample, asked = [x for x in rows if x[0] % 3 != 1], [x for x in rows if x[0] % 3 == 1]
    m = toxicity.Model([x[0] for x in sample], [x[1] for x in sample], [x[2] for x in sample], 0.3, least_chi)
    df = np.bincount(m.counts(Words([x[1] for x in rows], PLAIN, True))[1], minlength=len(m.terms))
    m.index(dict(enumerate(df.tolist())), len(rows))
    bags = {i: term_counts(t) for i, t, _ in rows}
    spread = Counter(k for b in bags.values() for k in b)
    if least_chi:
        toxic = {i for i, _, y in sample if y}
        held = Counter(k for i, _, _ in sample for k in bags[i])
        held_toxic = Counter(k for i in toxic for k in bags[i])
        n, p = len(sample), len(toxic)

        def keeps(k):
            a, all_ = held_toxic[k], held[k]
            off = a * (n - p - all_ + a) - (p - a) * (all_ - a)
            return off > n / 2 and n * (off - n / 2) ** 2 / max(p * (n - p) * all_ * (n - all_), 1e-9) > least_chi

        bags = {i: Counter({k: c for k, c in b.items() if keeps(k)}) for i, b in bags.items()}

    def unit(bag):
        v = {k: (1 + math.log(c)) * (math.log((len(rows) + 1) / (spread[k] + 1)) + 1) for k, c in bag.items() if not least_chi or spread[k]}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {k: x / norm for k, x in v.items()}

    vectors = {x[0]: unit({k: c for k, c in bags[x[0]].items()}) for x in sample}
    known = {k for v in vectors.values() for k in v}
    asked_some = 0
    for i, t, _ in asked:
        d, term, x = m.weights(Words([t], PLAIN, True))
        q = unit({k: c for k, c in bags[i].items() if k in known})
        assert len(q) == len(d)
        if not len(d):
            continue
        cos = {j: sum(x * v[k] for k, x in q.items() if k in v) for j, v in vectors.items()}
        e, s = m.nearest(term, x, 15)
        want = sorted((c for c in cos.values() if c > 0), reverse=True)[:15]
        assert np.allclose(s, want) and np.allclose([cos[int(m.ids[j])] for j in e], s)
        asked_some += 1
    assert asked_some > 30
    if least_chi:
        assert m.read < 0.9 * asked_some * m.blocks  # blocks whose bound is too low stay unread


def test_toxicity_scores_are_calibrated():
    """On held-out labels: few errors, and of the documents with about one score, about that share is labelled."""
    import zlib

    import pyarrow.parquet as pq

    d = "/root/testdata/sf0.1"
    text = dict(zip(*pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values(), strict=True))
    labels = pq.read_table(f"{d}/labels.parquet").to_pydict()
    y = {i: t for i, t in zip(labels["doc_id"], labels["toxic"], strict=True) if t in (0, 1) and i in text}
    fit = [i for i in y if zlib.crc32(str(i).encode()) % 3 != 1 and len(text[i] or "") <= toxicity.EXAMPLE_CHARS]
    held = [i for i in y if zlib.crc32(str(i).encode()) % 3 == 1]
    m = toxicity.Model(fit, [text[i] for i in fit], [y[i] for i in fit], sum(y[i] for i in fit) / len(fit))
    df = np.bincount(m.counts(Words([text[i] for i in held], PLAIN, True))[1], minlength=len(m.terms))
    m.index(dict(enumerate(df.tolist())), len(held))
    got = np.array(m.score([text[i] for i in held], toxicity.NEIGHBOURS)[0])
    want = np.array([y[i] for i in held])
    assert ((got - want) ** 2).mean() < 0.04 and (got[want == 0] >= 0.7).mean() < 0.005 and (got[want == 1] >= 0.7).mean() > 0.6
    for lo in np.arange(0, 1, 0.25):
        some = (got >= lo) & (got < lo + 0.25001)
        assert some.sum() < 20 or abs(got[some].mean() - want[some].mean()) < 0.15


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert {r["score"] for r in toxicity.score(docs, model).collect()} == {0.0}
    assert toxicity.keep_clean(docs, model).count() == 2


def test_language_automaton_holds_all_substrings():
    r = random.Random(1)
    codes = [r.randrange(1, 4) for _ in range(200)]
    codes[50] = codes[120] = language.PAD
    trans = language.build_automaton(codes, 4)
    text = "".join(map(str, codes))
    for _ in range(500):
        q = [r.randrange(1, 4) for _ in range(r.randrange(1, 9))]
        s = 0
        for c in q:
            s = int(trans[s, c]) if s != language.DEAD else s
            if s == language.DEAD:
                break
        assert (s != language.DEAD) == ("".join(map(str, q)) in text)


def test_phrases_equal_greedy_parsing():
    m = language.Model({"aa": ["the cat sat on the mat", "a dog"], "bb": ["le chat est sur le tapis"]})
    text = "the dog sat sur la xyz mat " * 40
    codes = m.codes(text)
    for k, lang in enumerate(m.langs):
        sample = [m.codes(t).tolist() for t in {"aa": ["the cat sat on the mat", "a dog"], "bb": ["le chat est sur le tapis"]}[lang]]
        has = lambda q, sample=sample: any(q == s[i : i + len(q)] for s in sample for i in range(len(s) - len(q) + 1))
        n = 0
        for lo in range(0, len(codes), language.LANE):
            lane, at = codes[lo : lo + language.LANE].tolist(), 0
            closed = True
            while at < len(lane):
                end = at + 1
                if has(lane[at:end]):
                    while end < len(lane) and has(lane[at : end + 1]):
                        end += 1
                n += 1
                closed = not has(lane[at:end])
                at = end
            n += closed  # an open last phrase is counted by the parser as well
        assert abs(m.phrases([codes])[0, k] / m.bits[k] - n) <= 1


def test_sparse_automaton_equals_dense():
    r = random.Random(2)
    codes = [r.choice([language.PAD, *range(1, 9), *range(300, 330)]) for _ in range(3000)]
    dense, (owner, target) = language.build_automaton(codes, 330), language.build_sparse(codes, 330)
    pairs, seen = [(0, 0)], {0: 0}
    while pairs:
        a, b = pairs.pop()
        for c in range(1, 330):
            assert (dense[a, c] != language.DEAD) == (owner[b + c] == b)
            if owner[b + c] == b:
                x, y = int(dense[a, c]), int(target[b + c])
                if x not in seen:
                    pairs.append((x, y))
                assert seen.setdefault(x, y) == y
    assert len(seen) == len(dense) == len(set(seen.values()))


def test_language_after_a_shared_header(spark):
    """Spans come from the whole text, not from what all texts begin with."""
    head = "this work is free and may be copied by all under the terms below " * 12
    words = {"aa": ["bokri", "fundal", "tesmo", "grivu", "palen"], "bb": ["zuchet", "wimora", "yeskil", "hodaq", "jurnix"]}
    r = random.Random(4)
    body = lambda k: " ".join(r.choice(words[k]) for _ in range(400))
    docs = spark.createDataFrame([(i, head + body(k), k) for i, k in enumerate(["aa", "bb"] * 40)], "doc_id long, text string, lang string")
    m = language.fit(docs, F.lit(True))
    assert m.predict([body(k) for k in ["aa", "bb"] * 20])[0] == ["aa", "bb"] * 20


def test_language_of_many_scripts():
    """No letter is cut, however many scripts the samples have."""
    r = random.Random(5)
    text = lambda first, n: " ".join("".join(chr(first + r.randrange(n)) for _ in range(6)) for _ in range(300))
    scripts = {"latin": (97, 26), "cyrillic": (0x430, 32), "armenian": (0x561, 38), "georgian": (0x10D0, 33), "han": (0x4E00, 500), "han2": (0x6000, 500), "hangul": (0xAC00, 500), "gothic": (0x10330, 20)}
    m = language.Model({k: [text(*v) for _ in range(20)] for k, v in scripts.items()})
    assert m.predict([text(*v) for v in scripts.values()])[0] == list(scripts)


def test_language_sample_does_not_shrink():
    r = random.Random(6)
    long = ["".join(r.choices("abcdefgh ", k=500)) for _ in range(40)]
    m = language.Model({"aa": long} | {f"l{i}": ["xyz"] for i in range(400)})
    assert 2 ** m.bits[0] > 17_000
    one = language.Model({"aa": ["".join(r.choices("abcdefgh ", k=50_000))]})
    assert 2 ** one.bits[0] > 0.9 * language.SAMPLE_CHARS


@pytest.mark.parametrize("small", ["", " ", "ab", "12 - 3", "a the "])
def test_language_of_a_tiny_sample_does_not_win(spark, small):
    """A label with one blank or very short text takes no document of the languages that have text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(-1, small, "zz")], "doc_id long, text string, lang string")
    got = language.identify(docs, language.fit(docs.union(more), F.lit(True))).join(docs, "doc_id")
    assert got.where("lang_pred = 'zz'").count() == 0
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_language_of_few_documents():
    """Two sentences a language suffice to tell scripts and plain cases apart; unknown letters decide nothing."""
    m = language.Model({"en": ["the quick brown fox jumps over the lazy dog and runs away"], "ru": ["съешь ещё этих мягких французских булок да выпей чаю"], "zh": ["我能吞下玻璃而不伤身体"], "x": ["q"], "none": ["1 2 3"]})
    assert m.langs == ["en", "ru", "x", "zh"]
    got = m.predict(["the brown dog jumps over the fox", "выпей мягких булок", "玻璃身体", "² ½ 3", "ქართული ენა", "the ქართული dog"])[0]
    assert got[:4] == ["en", "ru", "zh", "und"] and got[4] != "und" and got[5] == "en"


def test_repeated_rows_of_a_drawn_id_count_once(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog " * 20, "en")] * 200 + [(2, "der Hund und die Katze " * 20, "de")], "doc_id long, text string, lang string")
    m = language.fit(docs, F.lit(True))
    assert 2 ** m.bits[1] < 500


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = language.identify(docs, language.fit(docs, ~held)).join(docs, "doc_id").where(held)
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_of_texts_without_letters(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "12 - 3", None), (5, "", "de")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(docs, language.fit(docs, F.lit(True))).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 6)] == ["en", "de", "und", "und", "und"]
    assert got[4]["score"] == 0 and 0 <= got[1]["score"] <= 1
    empty = language.fit(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language.identify(docs, empty).collect()} == {"und"}


def brute_contamination(docs, items, n=13):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for i, t in items:
        w = find(t)
        k = min(n, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[s : s + k]), set()).add(str(i))
    sizes = {len(g) for g in wins}
    out = []
    for i, t in docs:
        w = find(t)
        hit, ids = set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if got := wins.get(tuple(w[s : s + k])):
                    hit.update(range(s, s + k))
                    ids |= got
        out.append((i, len(w), len(hit), tuple(sorted(ids)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return Counter(out)


@pytest.mark.parametrize("block_words", [100_000, 60])
def test_contamination_equals_brute_force(spark, docs, rows, monkeypatch, block_words):
    monkeypatch.setattr(contamination, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(contamination, "AT_ONCE", 50)
    plain = [(r[0], r[1]) for r in rows]
    items = [(1, " ".join((rows[7][1]).split()[20:60])), ("2", "one"), (3, None), (4, ""), (5, (rows[12][1]).upper()), (6, "the er the on"), (6, "nowhere to be found"), (7, "the")]
    table = spark.createDataFrame([(str(i), t, 0) for i, t in items] + [(None, "the", 0)], "item_id string, text string, extra int")
    got = contamination.contamination(docs, table)
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got.collect()) == brute_contamination(plain, [x for x in items if x[1] is not None])
    kept = contamination.keep_uncontaminated(docs, table)
    assert kept.columns == docs.columns and kept.count() == got.where("not contaminated").count()


def test_contamination_without_items_or_documents(spark, docs, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert contamination.contamination(docs, empty).where("n_hit > 0 or contaminated").count() == 0
    assert contamination.contamination(none, empty).count() == 0


def test_proximity_and_postings(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma z delta"), (2, "alpha " + "far " * 50 + "beta gamma delta"), (3, "Alpha alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "delta gamma beta alpha")], "item_id long, text string")
    got = {r["doc_id"]: r["near_items"] for r in contamination.contamination(docs, items, slack=5).collect()}
    assert got == {1: 1, 2: 0, 3: 0}
    post = {(r["term"], r["doc_id"]): r["positions"] for r in contamination.postings(docs, spark.createDataFrame([("alpha",), ("delta",)], "term string")).collect()}
    assert post == {("alpha", 1): [0], ("delta", 1): [6], ("alpha", 2): [0], ("delta", 2): [53], ("alpha", 3): [0, 1]}
    assert math.isclose(sum(len(p) for p in post.values()), 6)
