"""Bottom-k fingerprints against exact sets."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from faultline.llm import sketches


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edited_texts(make_docs):
    rng = random.Random(2)
    given = [(i, " ".join(rng.choice("abcdefghij") * 3 for _ in range(rng.randrange(1, 90)))) for i in range(0, 120, 3)]
    given += [(1, None), (2, ""), (4, "é😀 " * 7), (5, "x" * 5000), (200, given[3][1]), (201, given[3][1])]
    # Exact while all shingles of two texts fit in a sketch.
    rows = {r.doc_id: r for r in sketches.compare_with_edits(make_docs(given), size=512).collect()}
    assert len(rows) == len(given)
    given.sort()
    for i, (doc, text) in enumerate(given):
        text, after = text or "", given[(i + 1) % len(given)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = rows[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(alike(shingles(text), shingles(edited)))
        assert r.near_next == pytest.approx(alike(shingles(text), shingles(after)))
    assert rows[200].fingerprint == rows[201].fingerprint == rows[given[[d for d, _ in given].index(9)][0]].fingerprint


def test_next_rows_across_ranges(make_docs):
    given = [(i * i, f"t{i}") for i in range(50)]
    rows = sketches.with_next(make_docs(given).select("doc_id", "text"), ["text"], rows_per_range=4).collect()
    assert {r.doc_id: r.next_text for r in rows} == {d: given[(i + 1) % 50][1] for i, (d, _) in enumerate(given)}


def test_one_row_none_and_null_ids(make_docs):
    one = sketches.compare_with_edits(make_docs([(7, "ab")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"aa").hexdigest() and one.near_next == 1.0
    assert sketches.compare_with_edits(make_docs([])).count() == 0
    assert sketches.compare_with_edits(make_docs([(None, "x y"), (None, None), (3, "z")])).count() == 3


def test_merged_parts_and_estimates(spark):
    words = [f"w{i}" for i in range(4000)]
    whole = " ".join(words)
    # Parts overlap by four words, so their shingles together are those of the whole.
    parts = [(1, " ".join(words[max(0, i - 4) : i + 500])) for i in range(0, 4000, 500)]
    df = spark.createDataFrame([(0, whole), (2, " ".join(words[:2000]))], "key long, text string")
    exact = {r.key: r.s for r in sketches.with_sketch(df, "text", "s").collect()}
    merged = sketches.merge(sketches.with_sketch(spark.createDataFrame(parts, "key long, text string"), "text", "s"), "key", "s").first()
    assert merged.s == exact[0]
    both = spark.createDataFrame([(exact[0], exact[2])], "a array<long>, b array<long>")
    r = both.select(
        sketches.distinct_count(F.col("a")).alias("n"), sketches.resemblance(F.col("a"), F.col("b")).alias("j"),
        sketches.containment(F.col("b"), F.col("a")).alias("inside")).first()
    assert r.n == pytest.approx(3996, rel=0.35) and r.j == pytest.approx(0.5, abs=0.15) and r.inside == pytest.approx(1, abs=0.3)
