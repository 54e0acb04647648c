"""Tokenising, packing and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lexquarry.llm import packing


def reference_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_runs_give_the_library_ids():
    r = random.Random(6)
    alphabet = [" ", " ", "  ", "\n", "\t ", "'s", " 's", "don't", "é", "ß", "12", "a1", "...", "<|endoftext|>", " ", "\x1c", "word", "Тест", "🙂", "\r\n", " \n "]
    texts = ["".join(r.choices(alphabet, k=r.randint(1, 30))) for _ in range(3000)] + ["", " ", "a b c", " a b", "a b ", "a  b c d"]
    enc = packing._Encoder("byte_bpe_50k.tiktoken")
    assert [np.frombuffer(enc(t), dtype="<u4").tolist() for t in texts] == reference_ids(texts)


def test_pieces_and_sequences(docs, rows):
    got = packing.pack(docs, capacity=256).collect()
    want = Counter()
    for (k, *_), ids in zip(rows, reference_ids([r[1] or "" for r in rows]), strict=True):
        ids = [*ids, 0]
        first = len(ids) - (len(ids) - 1) // 256 * 256
        at, piece = 0, 0
        for to in range(first, len(ids) + 1, 256):
            want[(k, piece, at, to - at, zlib.crc32(np.array(ids[at:to], dtype="<u4").tobytes()))] += 1
            at, piece = to, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 256
    ideal = sum(r["length"] for r in got) / 256
    assert len(by) <= ideal * 1.1 + 1


def test_plan_places_every_document():
    r = random.Random(7)
    for _ in range(30):
        counts = Counter(r.choices(range(1, 65), k=r.randint(0, 400)))
        segments, n = packing.plan(dict(counts), 64)
        filled = defaultdict(list)
        ranks = defaultdict(set)
        for length, rank, c, first, offset in segments:
            for i in range(c):
                filled[first + i].append((offset, length))
                assert rank + i not in ranks[length]
                ranks[length].add(rank + i)
        assert all(ranks[k] == set(range(c)) for k, c in counts.items()) and len(filled) == n
        for v in filled.values():
            v.sort()
            assert all(a[0] + a[1] == b[0] for a, b in zip(v, v[1:], strict=False)) and v[0][0] == 0 and sum(x[1] for x in v) <= 64


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        i = min((i for i, x in enumerate(rooms) if x >= n), key=lambda i: rooms[i], default=None)
        if i is None:
            rooms.append(capacity - n)
        else:
            rooms[i] -= n
    return len(rooms)


def test_as_few_sequences_as_best_fit_over_single_documents():
    r = random.Random(9)
    for _ in range(60):
        capacity = r.choice([10, 64, 500])
        lengths = r.choices(range(1, r.choice([5, capacity]) + 1), k=r.randint(0, 300))
        assert packing.fills(Counter(lengths), capacity)[1] == best_fit_decreasing(lengths, capacity)


def test_sequences_of_the_small_table(spark):
    """No more sequences than best-fit over single pieces, which here is the least number that can be."""
    got = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("length", "sequence_id").collect()
    n = len({x["sequence_id"] for x in got})
    assert n == best_fit_decreasing([x["length"] for x in got], 2048) == -(-sum(x["length"] for x in got) // 2048)


def test_repeated_rows_do_not_share_a_place(spark):
    docs = spark.createDataFrame([(1, "one two three")] * 500 + [(None, None)] * 300, "doc_id long, text string")
    got = packing.pack(docs, capacity=64).collect()
    assert len(got) == 800 and len({(x["sequence_id"], x["offset"]) for x in got}) == 800


def test_no_documents(none):
    assert packing.pack(none).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p
    from tests.llm.test_duplicates import brute_groups
    from tests.llm.test_models import brute_contamination
    from tests.llm.test_native import brute_base

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(p.STAGES)
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    clean = stages["toxicity"](spark, docs, d)
    assert clean.columns == docs.columns and 0.7 * docs.count() < clean.count() <= docs.count()
    one = stages["near_duplicates"](spark, docs, d)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    groups = brute_groups(rows, 5, 80)
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    bad = {k[0] for k in brute_contamination(rows, items) if k[4]}
    left = stages["decontamination"](spark, docs, d)
    assert {r["doc_id"] for r in left.collect()} == {i for i, _ in rows} - bad
    masked = {r["doc_id"]: r for r in stages["secrets"](spark, docs, d).collect()}
    assert len(masked) == len(rows)
    for i, t in rows:
        assert masked[i]["n_chars"] == len(masked[i]["text"])
        if brute_base(t):
            assert "[SECRET]" in masked[i]["text"]
    packed = p.run(spark, d)
    assert {r["doc_id"] for r in packed.collect()} <= {i for i, _ in rows} - bad


def test_stages_take_extra_columns_and_nulls(spark, docs, rows):
    import corpus_pipeline as p

    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= len(rows), name
        empty = stage(spark, docs.limit(0), "/root/testdata/sf0.001")
        assert empty.count() == 0, name


def test_kept_ids_are_found_before_texts_move(spark):
    """pipeline: the last stages of the near-duplicate groups ran in one execution with the join that moves the texts."""
    import corpus_pipeline as p

    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (None, "g"), (3, None)], "doc_id long, text string")
    out = p.drop_near_duplicates(spark, docs, "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "class_id" not in plan and "d0" not in plan
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "a b c d e f"), (3, None), (None, "g")]
