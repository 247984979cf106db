import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _doc string, size string, shard string, label string, _h string"


def made(seed=1, n=60):
    """Rows with nulls, ties, repeated rows, copies, empty and very long texts."""
    r = random.Random(seed)
    syl = ["ba", "ko", "ti", "mé", "ra", "Su", "le", "nö"]
    words = ["".join(r.choice(syl) for _ in range(r.randint(1, 4))) for _ in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(n)]
    for k in range(0, n, 6):  # near copies
        w = texts[k].split(" ")
        w[len(w) // 2] = "other"
        texts[k + 1] = " ".join(w)
        texts[k + 2] = texts[k].upper()
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["a", "b", "Z", None])) for i, t in enumerate(texts)]
    rows += [(1000, None, None, None), (1001, "", "en", "a"), (1002, " \t\n\r ", "de", "b"), (1003, "one", "en", "a"), (1004, "ONE", "en", None), (1005, "é" * 5000 + " " + "x y " * 30000, "en", "a")]
    rows += [rows[0], rows[0], (None, texts[3], "en", "a"), (None, None, None, None)]
    return [(*x, None if x[1] is None else len(x[1]), "clash", "clash", "clash", "clash", "clash") for x in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
