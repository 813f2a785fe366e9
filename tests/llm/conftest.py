"""A small table with nulls, empty and very long texts, ties, repeated rows and columns whose names the operators also use."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, kept boolean, key string, part int, copies int, target double"


def _rows():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)] + ["café", "straße", "mail", "naïve", "ÀB"]
    base = [" ".join(rng.choices(words, k=rng.choice([4, 30, 60, 120]))) for _ in range(60)]
    texts = list(base)
    for _ in range(70):  # near copies of one text: one long list
        t = base[1].split() + ["tail"]
        for _ in range(rng.choice([0, 1, 2])):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    texts += [base[2]] * 5 + [base[3].upper(), None, "", "   ", "\t\n\x0b", "one", "two words", "two words", " " + base[4] + "  end ", " ".join(rng.choices(words, k=20_000))]
    texts += ["Write to ann.lee@example.com or call +44 20 7946 0958.", "IP 10.20.30.40 and 300.1.1.1, card 4111 1111 1111 1111 paid", "bad card 4111 1111 1111 1112; a@b, x@y.z@w.org ünï a@b.cc", "phone: (555) 123-4567, ann (at) example (dot) com; api_key=abc123def456"]
    sources = ["big", "big", "big", "b", "ünder", None, "z"]
    rows = [(k, t, "en", rng.choice(sources), len(t or ""), 1, 0.5, False, "k", 3, 2, 1.0) for k, t in enumerate(texts)]
    return [*rows, rows[0], rows[2], (None, "null id text here", "en", None, 4, 1, 0.5, True, "k", 3, 2, 1.0)]


@pytest.fixture(scope="session")
def rows():
    return _rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
