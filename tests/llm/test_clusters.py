"""Clusters through subvector dictionaries against plain arithmetic."""

import hashlib
import math
import random

import numpy as np
import pytest

from faultline.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, label int, key long, cluster string, distance string, v int, centroid string, cluster_inertia int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x", "y", 2, "z", 3) for i, v in rows], SCHEMA).repartition(3)


def expected(rows, k=8, rounds=10):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in order[:k]]
    if not centroids:
        return []
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((distance(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centroids = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centroids, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = [sum(d for _, d, c in found if c == n) for n in range(len(centroids))]
    return sorted(str((i, c, d, inertia[c], sum(inertia), centroids[c])) for i, d, c in found)


def run(spark, rows, **options):
    found, centroids = clusters.cluster(table(spark, rows), **options)
    return sorted(
        str((r.key, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid)) for r in clusters.with_inertia(found, centroids).collect())


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(8)
    centres = [[rng.gauss(0, 0.3) for _ in range(64)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in rng.choice(centres)]) for i in range(300)]
    rows += [(1000 + i, list(centres[0])) for i in range(150)]  # copies
    rows += [(None, list(centres[1])), (7, None), (8, []), (9, [0.0] * 63), (10, [0.0] * 65), (11, [0.0] * 63 + [None]), (12, [float("nan")] + [0.0] * 63)]
    return rows + [(13, [float("-inf")] * 64), (14, [-0.0] * 64), (15, [-1e-9] * 64), (2, rows[2][1]), (2, rows[3][1]), (16, [1e4] * 64)]


def test_against_plain_arithmetic(spark, vectors):
    assert run(spark, vectors) == expected(vectors)


def test_few_none_and_too_large(spark, vectors):
    few = vectors[:5]
    assert run(spark, few) == expected(few) and len({r.split(", ")[1] for r in run(spark, few)}) == 5
    assert run(spark, []) == [] and run(spark, [(1, None)]) == [] and run(spark, [(None, [0.5] * 64)]) == []
    assert run(spark, [*few, (99, [1e30] * 64)]) == expected(few)


def test_chunks_and_partitions_do_not_matter(spark, vectors, monkeypatch):
    rows = clusters.whole_numbers(table(spark, vectors))
    start = clusters.start(rows, 8, 3)
    moved = [clusters.moved(clusters.pack(rows.repartition(n), chunk), start).tolist() for n, chunk in ((1, 1000), (4, 17), (2, 1))]
    assert moved[0] == moved[1] == moved[2]


def test_dictionaries_lose_nothing_and_join_copies():
    rng = np.random.default_rng(3)
    for v in (rng.integers(-9, 9, (500, 64)), np.repeat(rng.integers(-500, 500, (7, 64)), 90, 0), rng.integers(-(1 << 27), 1 << 27, (40, 64)), np.zeros((3, 64), np.int64)):
        blocks = clusters.encode(v)
        assert (np.hstack([entries[codes] for entries, codes in blocks]) == v).all()
        assert all(len(np.unique(e, axis=0)) == len(e) for e, _ in blocks)
    assert len(clusters.encode(np.repeat(rng.integers(-500, 500, (7, 64)), 90, 0))) == 1
