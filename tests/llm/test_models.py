"""Held-out accuracy and defined results of the two text models."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import langid, quality

SYLLABLES = {"aa": "ka mo ri tu na sel".split(), "bb": "the ing wor sh ald ock".split(), "cc": "été que ion oux ère lle".split()}


def text_of(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_languages(make_docs, odd_texts):
    rng = random.Random(4)
    given = [(i, text_of(rng, lang, rng.randrange(1, 80)), lang if i % 5 else None) for i, lang in enumerate(rng.choices("aa bb cc".split(), (8, 1, 1), k=300))]
    truth = {d: t for d, _, t in given if t}
    given += [(d + 1000 if d else None, t) for d, t in odd_texts]
    rows = langid.identify(make_docs(given), per_language=40, landmarks=8).collect()
    assert len(rows) == len(given)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    told = {r.doc_id: r.lang_pred for r in rows}
    assert all(told[d + 1000] == "und" for d in (1, 2, 3, 14)) and told[1011] != "und"
    copies = {(r.lang_pred, r.score) for r in rows if r.doc_id == 1009}
    assert len(copies) == 1
    kept = langid.known(make_docs(given))
    assert kept.columns == make_docs([]).columns and {1001, 1002, 1003, 1014}.isdisjoint({r.doc_id for r in kept.collect()})


def test_blocks_of_a_text_give_the_same_presence(monkeypatch):
    text = "Été, là-bas! " * 50 + "fin"
    whole, parts = np.zeros(langid.BUCKETS, np.uint8), np.zeros(langid.BUCKETS, np.uint8)
    assert langid.presence(text, whole)
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert langid.presence(text, parts) and (whole == parts).all()


def test_no_language_to_learn(make_docs):
    assert {r.lang_pred for r in langid.identify(make_docs([(1, "a b"), (2, None)])).collect()} == {"und"}
    assert langid.identify(make_docs([])).count() == 0


def test_copies_do_not_thin_a_language(make_docs):
    rng = random.Random(8)
    texts = [text_of(rng, "aa", 12) for _ in range(60)]
    given = [(4 * i, t, "aa") for i, t in enumerate([*texts, *[texts[0]] * 6000])] + [(None, None, "bb")]
    for per_language in (10, 40, 400):
        rows = langid.training(make_docs(given), F.lit(False), per_language).collect()
        assert len(rows) == len(set(rows)) == min(per_language, 60)


@pytest.fixture(scope="module")
def rated():
    rng = random.Random(6)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    rows = []
    for i in range(900):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 80))]
        toxic, poor = rng.random() < 0.2, rng.random() < 0.2
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "rotten", "scum"]) + rng.choice(["", "ly", "!"]))
        if poor:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), int(not poor), int(toxic)))
    return rows


def test_grades(spark, make_docs, odd_texts, rated):
    given = [(d, t) for d, t, _, _ in rated] + [(d + 5000 if d else None, t) for d, t in odd_texts]
    labels = [(d, q, x) for d, _, q, x in rated if d % 3] + [(0, None, 1), (None, 1, 0), (77_777, 1, 0)]
    frame = spark.createDataFrame([(*r, "t") for r in labels], "doc_id long, quality int, toxic int, text string")
    rows = {r.doc_id: r for r in quality.grade(make_docs(given), frame).collect()}
    truth = {d: q + 1 - x for d, _, q, x in rated if d % 3 == 0}
    good = [d for d, g in truth.items() if g == 2]
    assert np.mean([rows[d].kept for d in good]) > 0.95
    assert np.mean([not rows[d].kept for d, g in truth.items() if g < 2]) > 0.9
    mean = lambda g: np.mean([rows[d].expected_grade for d, x in truth.items() if x == g])
    assert mean(0) < mean(1) < mean(2)
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in rows.values())
    kept = {r.doc_id for r in quality.good(make_docs(given), frame).collect()}
    assert kept == {d for d, r in rows.items() if r.kept}
    few = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {(r.expected_grade, r.kept) for r in quality.grade(make_docs(given), few).collect()} == {(None, True)}
    assert quality.grade(make_docs([]), frame).count() == 0


def test_sample_of_ratings(spark, make_docs, monkeypatch):
    monkeypatch.setattr(quality, "fit", lambda rows: [g for g, _, _ in rows])
    docs = make_docs([(i, f"text {i}") for i in range(6500)])
    rated = spark.createDataFrame([(i, i % 3) for i in range(6500)], "doc_id long, grade int")
    assert len(quality.model_of(docs, rated)) == 6000
    assert len(quality.model_of(docs, rated.where("doc_id < 4000"))) == 4000


def test_token_scores_equal_features(rated):
    rng = np.random.default_rng(1)
    weights = rng.normal(size=quality.BUCKETS)
    known = quality.TokenScores(weights)
    for _, text, _, _ in rated[:40]:
        at, value = quality.features(text)
        assert known.score(text) == pytest.approx(float(weights[at] @ value), abs=1e-4)
    assert known.score(None) == known.score("") == 0.0
