"""Shards against the law they state."""

import zlib
from collections import Counter

from faultline.llm import shards


def check(rows, given, n, slack):
    assert len(rows) == len(given)
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in given)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    sizes = [sum(r["size"] for r in rows if r.shard == k) for k in range(n)]
    for k in range(n):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    largest, total = max(r["size"] for r in rows), sum(sizes)
    assert max(sizes) - min(sizes) <= 2 * max(largest, slack * total / n)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_odd_rows(make_docs, odd_texts):
    check(shards.shard(make_docs(odd_texts), 8, 0.02, rows_per_range=4).collect(), odd_texts, 8, 0.02)


def test_a_hot_group_is_divided_and_small_groups_are_not(make_docs):
    given = [(i, "same text " * 5) for i in range(400)] + [(1000 + i, f"text {i // 2} " * (1 + i % 7)) for i in range(800)]
    rows = shards.shard(make_docs(given), 8, 0.02, rows_per_range=50).collect()
    check(rows, given, 8, 0.02)
    homes = {}
    texts = dict(given)
    for r in rows:
        homes.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert len(homes.pop("same text " * 5)) > 1
    assert all(len(found) == 1 for found in homes.values())


def test_the_same_places_whatever_the_ranges(make_docs):
    given = [(i, "x" * (i * i % 97)) for i in range(300)]
    one, other = ({(r.doc_id, r.shard, r.slot) for r in shards.shard(make_docs(given), 8, 0.02, n).collect()} for n in (7, 1000))
    assert one == other


def test_empty(make_docs):
    assert shards.shard(make_docs([]), 8).count() == 0
