import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, a string, key string, n int"
#: Columns id, a, key and n clash with names that operators use inside.


def frame(spark, texts, lang="en", source="s"):
    rows = [(k, t, lang, source, len(t or ""), 7, "x", "y", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, words=400):
    return " ".join("w" + str(int(words * rng.random() ** 2)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Odd texts, exact and near copies, shared passages, periodic and long ones."""
    rng = random.Random(1)
    base = [prose(rng, n) for n in (1, 2, 3, 30, 60, 200, 3000)]
    near = [" ".join(w if rng.random() > 0.02 else "edit%d" % rng.randrange(99) for w in base[5].split()) for _ in range(12)]
    passage = prose(rng, 60, 10_000)
    holders = [prose(rng, 20) + "\n" + passage + "\n" + prose(rng, 25) for _ in range(6)]
    odd = [None, "", " \n\t", "ünï çödé 漢字 😀 it's they'll", "a" * 500, "ab " * 200, "<|endoftext|> x", "\x00\x1c\x85", "# $ % &"]
    return base + near + holders + odd + [base[4], base[4].upper(), base[3], None, ""]


@pytest.fixture
def docs(spark, texts):
    return frame(spark, texts)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
