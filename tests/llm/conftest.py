import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, label string, bands string"


def make_texts(seed=5):
    """Texts with nulls, empty and very long ones, exact and near copies, shared passages, ties and repeated rows."""
    r = random.Random(seed)
    syllables = ["tion", "er", "on", "the", "and", "ou", "ré", "ßen", "ñi", "st", "wh"]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    prose = lambda n: " ".join(w.capitalize() if r.random() < 0.1 else w for w in (word() for _ in range(n)))
    passage = prose(40)
    out = [None, "", " \n\t ", "one", "two words", "one", prose(3)]
    base = prose(200)
    out += [base, base, base.upper(), base.replace(base.split()[50], "changed", 1), " ".join(base.split()[:-10]), prose(150) + " " + passage, prose(80) + "\n" + passage + "\n" + prose(10)]
    for _ in range(30):
        t = prose(r.randint(1, 120))
        if r.random() < 0.3:
            t += ".\n\n" + passage[: r.randint(50, len(passage))]
        out.append(t)
        if r.random() < 0.3:
            ws = t.split()
            for _ in range(max(1, len(ws) // 40)):
                ws[r.randrange(len(ws))] = word()
            out.append(" ".join(ws))
    out.append(prose(20_000))
    out.append("x" * 100_000)
    return out


@pytest.fixture(scope="session")
def rows():
    texts = make_texts()
    out = [(3 * i + 1, t, "en", "s", len(t or ""), "b", "l", "x") for i, t in enumerate(texts)]
    out.append(out[8])  # a repeated row
    out.append((None, "a row without id " * 5, None, None, None, None, None, None))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
