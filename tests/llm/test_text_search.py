"""Licenses, benchmark passages and near duplicates against brute force."""

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from faultline.llm import decontam, licences, neardup
from faultline.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower().decode())


def test_licences(make_docs, odd_texts):
    notice = "Permission is hereby granted, free of charge, to any lucky person obtaining a copy of this software and associated documentation files"
    given = [*odd_texts, (200, "MIT License. The mit LICENSE"), (201, notice), (202, "gnu general public, license; CC-BY apache\nlicense"),
             (203, "cc by " * 3000), (204, "Licensed under CC BY-NC 4.0."), (205, "permission to obtain a copy of the files")]
    rows = {}
    for r in licences.scan(make_docs(given)).collect():
        rows.setdefault(r.doc_id, []).append(r)
    for doc, text in given:
        w = words(text)
        places = sorted((i, label) for phrase, label in licences.BASE.items() for q in [phrase.split()]
                        for i in range(len(w)) if w[i : i + len(q)] == q)
        for r in rows[doc]:
            assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted({p[1] for p in places})))
            assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert len(rows[9]) == 2 and rows[201][0].labels == "mit-text" and 0.75 <= rows[201][0].score <= 1
    assert rows[204][0].labels == "cc-by,cc-by-nc-4.0" and rows[205][0].labels == ""
    assert licences.scan(make_docs([])).count() == 0


def best_share(item, text, k=5):
    h, w = words(item), words(text)
    k = min(k, len(h))
    own = {tuple(h[i : i + k]) for i in range(len(h) - k + 1)}
    best = 0
    for at in range(-len(h), len(w)):
        part = w[max(0, at - 2) : max(0, at + len(h) + 2)]
        best = max(best, len(own & {tuple(part[i : i + k]) for i in range(len(part) - k + 1)}) / len(own))
    return best


def test_benchmark_passages(spark, make_docs, odd_texts):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 20, 41, 70])))) for i in range(25)]
    given = [*odd_texts]
    for n in range(60):
        item = items[rng.randrange(25)][1].split()
        if n % 3 == 1:
            item[rng.randrange(len(item))] = "changed"
        if n % 3 == 2:
            item = item[: len(item) // 2]
        fill = lambda: [rng.choice(vocabulary) for _ in range(rng.randrange(200))]
        given.append((300 + n, "\n".join([*fill(), *[x.upper() + "," for x in item], *fill()])))
    bench = spark.createDataFrame([(*r, "q") for r in [*items, (97, None), (98, ""), (99, "...")]], "item_id long, text string, doc_id string")
    docs = make_docs(given)
    weighted = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    shares = {(d, i): best_share(item, text) for d, text in given if text and len(text) < 20_000 for i, item in items}
    assert {p for p in weighted if p in shares} == {p for p, share in shares.items() if share >= 0.8 - 1e-9}
    dirty = {d for d, _ in weighted}
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} == {d for d, _ in given} - dirty
    assert decontam.leaks(make_docs([]), bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0
    assert decontam.clean(docs, bench.limit(0)).count() == len(given)


def test_benchmark_passages_with_spread_edits(spark, make_docs):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    edits = {15: 1, 30: 1, 60: 2, 100: 3, 150: 5, 200: 7, 400: 15}
    items, given = [], []
    for i, n in enumerate([*edits] * 8):
        items.append((i, " ".join(rng.choice(vocabulary) for _ in range(n))))
        text = items[-1][1].split()
        for e in range(edits[n]):
            at = rng.randrange(len(text))
            text[at : at + rng.choice([0, 1, 1])] = rng.choice([["new"], ["new"], []])
        given.append((i, " ".join(["before"] * 30 + text + ["after"] * 30)))
    bench = spark.createDataFrame([(*r, "q") for r in items], "item_id long, text string, doc_id string")
    shares = {i: best_share(items[i][1], text) for i, text in given}
    found = {r.doc_id: r.similarity for r in decontam.leaks(make_docs(given), bench).collect() if r.doc_id == r.item_id}
    wanted = {i: share for i, share in shares.items() if share >= 0.8 - 1e-9}
    assert len(wanted) > 30 and found == pytest.approx(wanted)
    assert {r.doc_id for r in decontam.clean(make_docs(given), bench).collect()} == shares.keys() - wanted.keys()


def shingles(text, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").encode().lower().decode()) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def expected(given, k):
    sets = {d: shingles(t, k) for d, t in given if d is not None}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_near_duplicates(make_docs, odd_texts):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(900)]
    given = [r for r in odd_texts]
    for family in range(6):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for n in range(25):
            copy = list(base)
            for _ in range(rng.randrange(7)):
                copy[rng.randrange(120)] = rng.choice(vocabulary)
            given.append((1000 * (family + 1) + n, " ".join(copy)))
    chain = [rng.choice(vocabulary) for _ in range(300)]
    given += [(9000 + i, " ".join(chain[5 * i : 5 * i + 150])) for i in range(20)]
    common = " ".join(vocabulary[:60])
    given += [(20_000 + i, f"{common} " + " ".join(rng.choice(vocabulary) for _ in range(25))) for i in range(60)]
    docs, want = make_docs(given), expected(given, 4)
    rows = neardup.near_duplicates(docs, k=4).collect()
    assert len(rows) == len(given)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    gone = {d for d, (_, c) in want.items() if d != c}
    assert sum(c != d for d, (_, c) in want.items()) > 60
    kept = neardup.one_of_each(docs, k=4)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in given} - gone


def test_blocks_of_a_bucket_join_what_is_alike(make_docs, monkeypatch):
    """Members in different components, in a bucket of several blocks: links join exactly what is linked."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    given = [(i, f"{'abcde'[i % 5]} " * 3 + " ".join(f"{'abcde'[i % 5]}{n}" for n in range(30)) + (f" z{i}" if i % 2 else "")) for i in range(22)]
    docs = make_docs(given)
    rows = neardup.sketch(docs, 4).selectExpr(
        "7 as bucket", "22L as size", "doc_id as node", "doc_id as component", "sig",
        "cast(concat(unhex('0700000000000000'), substring(keys, 9)) as binary) as bands").withColumn("bucket", F.lit(7).cast("long"))
    links = neardup.across(rows, docs, 4, 80)
    found = {r.node: r.component for r in components(links).collect()}
    assert found == {i: c for i, (_, c) in expected(given, 4).items()}
    assert links.count() <= 3 * 6 * 22


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(5, i) for i in range(30)] + [(50, 60), (60, 55), (5, 5)]])
def test_components(spark, links):
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for p in links for x in p if p[0] != p[1]}
    for _ in parent:
        for a, b in links:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert found == parent


def test_near_duplicates_of_nothing(make_docs):
    assert neardup.near_duplicates(make_docs([])).count() == 0
    assert neardup.near_duplicates(make_docs([(1, None), (2, "")])).where("kept").count() == 2
