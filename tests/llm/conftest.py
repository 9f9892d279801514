from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

# Columns that clash with names the operators use themselves.
EXTRA = ("kept", "node", "spans", "score", "y", "c", "seed", "word", "base", "row", "at", "key", "cluster", "n_tokens")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    + [T.StructField(name, T.StringType()) for name in EXTRA]
)


@pytest.fixture
def make_docs(spark):
    """A table of (doc_id, text) rows with clashing columns beside them."""

    def make(rows):
        return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], SCHEMA)

    return make


def sentence(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}{rng.choice('abc')}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts with near copies of all degrees, chains, a large group, short and odd texts."""
    rng = random.Random(3)
    texts = [sentence(rng, rng.randint(1, 120)) for _ in range(60)]
    for k in range(60):
        w = texts[k % 30].split()
        for _ in range(rng.randint(0, max(1, len(w) // 12))):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        texts.append(" ".join(w))
    original = sentence(rng, 146).split()
    for k in range(80):  # some close to each other, some to nothing
        w = list(original)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = f"y{rng.randrange(1000)}"
        texts.append(" ".join(w))
    texts += ["", " \t\n\x0b", None, "one", "one", "One two", "one two three four", "one two three four five", "ÀÉ é À"]
    texts += [texts[3], texts[3].upper(), sentence(rng, 30_000)]
    return dict(enumerate(texts, 100))


@pytest.fixture
def edge_rows():
    """Null ids and texts, empty and blank texts, ties and repeated rows, several texts for one id."""
    return [
        (None, None), (None, "no id but some text"), (1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"),
        (5, "the same id and another text"), (5, "the same id, yet another one"), (6, "x" * 200_000), (7, "a b " * 50_000),
        (8, "  ß ẞ 😀 é \x00 \x1f"),
    ]
