"""Importance resampling against plain counting of joined word runs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from faultline.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def expected(docs, items, percent=5, least=20):
    source, target = (Counter(bucket(f) for _, t in rows for f in features(t)[1]) for rows in (docs, items))
    s_all, t_all = sum(source.values()), sum(target.values())
    gain = {b: math.floor(1000 * math.log((target[b] + 1) * (s_all + 10_000) / ((source[b] + 1) * (t_all + 10_000)))) for b in range(10_000)}
    rows = []
    for doc, text in docs:
        n, found = features(text)
        weight = sum(gain[bucket(f)] for f in found)
        score = None
        if doc is not None:
            h = int(hashlib.sha256(f"42:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc, n, len(found), weight, score, None])
    able = sorted((r for r in rows if r[1] >= least and r[4] is not None), key=lambda r: (-r[4], r[0], r[2]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = i + 1
    return rows


def as_text(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


@pytest.fixture(scope="module")
def given(odd_texts):
    rng = random.Random(4)
    words = ["alpha", "Beta", "g4mma", "délta", "日本語", "e" * 70, "x"]
    more = [(500 + i, " ".join(rng.choice(words) + rng.choice(["", ".", "!\t", "\n"]) for _ in range(rng.randrange(80)))) for i in range(120)]
    return odd_texts + more


def test_against_plain_counts(spark, make_docs, given):
    items = [(1, "alpha beta gamma"), (2, None), (3, "ALPHA délta x x x 日本語 12 the of"), (3, "alpha beta gamma")]
    target = spark.createDataFrame(items, "item_id long, text string")
    for words in (50_000, 3, 0):  # results do not depend on the dictionary
        rows = resample.resample(make_docs(given), target, percent=30, words=words).collect()
        assert as_text(rows) == as_text(expected(given, items, percent=30)), words


def test_blocks_do_not_matter(monkeypatch, given):
    texts = [None if t is None else t.encode() for _, t in given]
    whole = sorted((int(o), int(b)) for _, os, bs in resample.Scanner([b"alpha", b"the"]).scan(texts) for o, b in zip(os, bs, strict=True))
    for size in (1, 7, 100):
        monkeypatch.setattr(resample, "BLOCK", size)
        parts = sorted((int(o), int(b)) for _, os, bs in resample.Scanner([b"alpha", b"the"]).scan(texts) for o, b in zip(os, bs, strict=True))
        assert parts == whole
    assert whole == sorted((i, bucket(f)) for i, (_, t) in enumerate(given) for f in features(t)[1])


def test_payloads_compose():
    rng = random.Random(1)
    pairs = [(rng.randbytes(rng.randrange(1, 900)), rng.randbytes(rng.randrange(1, 900))) for _ in range(200)]
    first, second = (np.array([zlib.crc32(p[i]) for p in pairs], np.uint32) for i in (0, 1))
    joined = resample.moved(first, np.array([len(b) for _, b in pairs])) ^ second
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_dictionary_counts_every_word(spark, make_docs, given):
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    count = Counter(f for _, t in [*given, (1, "alpha")] for f in features(t)[1] if " " not in f and len(f.encode()) <= resample.LONGEST)
    docs, level = make_docs(given), lambda n: math.floor(math.log2(n) * resample.LEVELS)
    for most in (0, 9, 25, 50_000):
        found = resample.dictionary(docs, items, most)
        # Whole classes of counts from the top, as many as fit.
        classes = sorted({level(n) for n in count.values()}, reverse=True)
        fits = [c for c in classes if sum(level(n) >= c for n in count.values()) <= most]
        assert found == sorted(w.encode() for w, n in count.items() if fits and level(n) >= fits[-1])


def test_empty_tables_and_equal_rows(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(make_docs([]), none).count() == 0
    text = "one two three four five six seven eight nine ten " * 3
    rows = resample.resample(make_docs([(7, text)] * 40 + [(8, None)]), none, percent=50).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 21)) and {r.weight for r in rows if r.doc_id == 8} == {0}
    assert resample.drawn(make_docs([(7, text), (9, text), (10, "short")]), none, percent=50).columns == make_docs([]).columns
