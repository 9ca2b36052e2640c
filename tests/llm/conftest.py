"""Small tables with nulls, empty and long texts, copies, near copies and columns whose names clash with the operators' own."""

import random

import pytest

random.seed(5)
VOCABULARY = [f"{a}{b}{c}" for a in ("ta", "ro", "mi", "ve") for b in ("lun", "der", "sik", "pom") for c in ("", "a", "eth", "os")]


def prose(n, seed):
    rng = random.Random(seed)
    words = [rng.choice(VOCABULARY) for _ in range(n)]
    return ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, n, 9)) + "."


BASE = prose(80, 1)
PASSAGE = prose(30, 2)
TEXTS = [
    BASE, BASE, BASE.replace("sik", "sik", 1) + " extra words", None, "", "   \n\t ", "Two words", "Two words", prose(400, 3), PASSAGE, prose(40, 4) + "\n" + PASSAGE + "\n" + prose(40, 5),
    "\U0001f600 Écrire à anna@mail1.example.com ou +1 (555) 123-4567, 10.0.0.255 et 4111 1111 1111 1111.", "a@b.c_d@e.f 1.2.3.4.5.6.7.8 999.1.1.1 4111111111111112 +12 a.b@c", prose(3000, 6), "x" * 70, "x" * 70, "x" * 200,
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", "s", 0 if t is None else len(t), True, 1.5) for i, t in enumerate(TEXTS)]
    rows += [(100, BASE, "en", "s", 0, False, None), (100, BASE, "en", "s", 0, False, None), (None, prose(50, 9), None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def texts(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]
