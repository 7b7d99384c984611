import random
import re

import pytest


def words(text):
    """Lower-cased (A-Z) words between blanks, as bytes."""
    low = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
    return [w for w in re.split(rb"[\x20\x09-\x0d]+", low) if w]


def make_rows(seed=1, n=60):
    """Texts with copies, near copies, shared passages, nulls, blanks, long words and a long text."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(20, 90))) for _ in range(12)]
    out = []
    for k in range(n):
        t = rng.choice(base)
        if rng.random() < 0.5:
            w = t.split(" ")
            w[rng.randrange(len(w))] = rng.choice(vocab).upper() + ","
            t = " ".join(w)
        if rng.random() < 0.3:
            t += "\n" + rng.choice(base)[:160] + "\t漢字 😀."
        out.append((3 * k, t))
    return out + [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "x" * 700), (1004, " ".join(base) * 12), (1005, "one two"), (1006, "One  two")]


@pytest.fixture(scope="session")
def corpus():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """With extra and clashing columns, in no order, over several partitions."""
    rows = [(i, t, "en" if i % 2 else None, "s", i * 2.0, i) for i, t in corpus]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fp double, block long").repartition(3).persist()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
