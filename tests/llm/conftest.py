import random

import pytest

EXTRA = ", row long, node long, size long, bucket string, score string, kept string, label string, range long, ids long, guest int, component string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long" + EXTRA


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows of (doc_id, text[, lang]) as a documents table with further columns whose names the operators use."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", 0, 1, 2, 3, "x", "y", "z", "w", 4, 5, 6, "c") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long, unsplit, special and non-Latin texts, ties and repeats."""
    rng = random.Random(5)
    words = ["the", "of", "Apache", "license", "é", "naïve", "it's", "we'll", "12", "x" * 40, "日本", "😀", "!!", "мир"]
    long = sentence(rng, words, 6000)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three"), (6, long), (7, "ab" * 30_000), (8, "<|endoftext|>a<|endoftext|>"),
        (9, long), (9, long), (10, "tail  of   spaces   "), (None, "no id at all here, really none"), (11, "ÀÉ ÇA 中文字   x"),
        (12, "'re've'" * 900), (13, "   " * 2000 + "end"), (14, "1234567890" * 1500),
        *[(100 + i, sentence(rng, words, rng.randrange(1, 60))) for i in range(30)],
    ]
