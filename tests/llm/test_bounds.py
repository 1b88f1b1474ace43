"""Cases at the edges of blocks, samples and hot lines, and results against forms written another way."""

import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from faultline.llm import arc, decontam, langid, quality, sketches, tokenfiles, words
from faultline.session import scratch


def test_pages_named_like_descriptions_are_pages(spark):
    given = [(1, "filedesc://a", "x" * 1500), (2, "filedesc:", "x" * 1500), (3, "http://b", "x" * 1500), (4, "filedesc://c", None), (5, "http://long", "word " * 300_000)]
    pages = spark.createDataFrame(given, "page_id long, url string, html string").repartition(2)
    rows = {r.page_id: r for r in arc.round_trip(pages, scratch(spark, "archives")).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5] and rows[5].payload_bytes == 1_500_000
    assert [(rows[i].record_type, rows[i].refers_to) for i in (1, 2, 3, 4)] == [("revisit", 3), ("revisit", 3), ("response", None), ("response", None)]


@pytest.mark.parametrize("version", [1, 2])
def test_plain_archives(spark, version):
    folder = scratch(spark, "archives")
    bodies = [f"HTTP/1.1 200 OK\r\n{arc.KEY}: {i}\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b for i, b in enumerate([b"", b"a\n\nb", b"x" * 5000, b"x" * 5000])]
    file = arc.SharedFile(folder, "old", ".arc")
    file.write(arc.description(version, "old.arc", arc.DATE))
    for body in bodies:
        file.write(arc.arc_record(version, "http://a/", arc.DATE, "text/html", body, 200, "old.arc", file.position))
    file.close()
    records = arc.scan_arc(spark.createDataFrame([(file.name, 4)], "archive string, records long"), folder)
    assert records.count() == 5
    rows = {r.page_id: r for r in arc.read_warc(arc.convert(arc.decide(records), folder), folder).collect()}
    assert [(rows[i].payload_bytes, rows[i].record_type, rows[i].refers_to) for i in range(4)] == [
        (0, "response", None), (4, "response", None), (5000, "revisit", 3), (5000, "response", None)]


def test_tokens_do_not_depend_on_blocks(monkeypatch):
    text = "splendid words, " * 40 + "x" * 300 + " end\x1cof it"
    whole = quality.tokens(text)
    assert whole == (len(text.split()), set(text.split()))
    for size in (1, 5, 64):
        monkeypatch.setattr(quality, "BLOCK", size)
        assert quality.tokens(text) == whole


def test_forms_are_whole():
    one, other = ("a1" * 40 + "-", "a1" * 40 + "+")
    assert quality.places(one)[1] != quality.places(other)[1]


def test_words_do_not_depend_on_blocks(monkeypatch):
    text = "Ab cdéf  " * 50 + "z" * 99
    for separators in (words.BLANKS, words.NOT_ALNUM):
        monkeypatch.setattr(words, "BLOCK", 256 << 10)
        whole = [x.tolist() for x in words.hashed_words(text, separators)[:3]]
        for size in (1, 7, 64):
            monkeypatch.setattr(words, "BLOCK", size)
            assert [x.tolist() for x in words.hashed_words(text, separators)[:3]] == whole


def test_a_dictionary_sample_reaches_all_of_a_text():
    ids = np.arange(100_000, dtype="<u4")
    pieces = [np.frombuffer(p, "<u4") for p in tokenfiles.drawn_pieces(ids.tobytes(), 8, 4096)]
    assert [len(p) for p in pieces] == [1024] * 8 and all((np.diff(p) == 1).all() for p in pieces)
    assert [int(p[0]) // 12_500 for p in pieces] == list(range(8))
    assert tokenfiles.drawn_pieces(b"abcd", 8, 4096) == [b"abcd"]


def test_a_line_that_many_items_share(spark, make_docs):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(4000)]
    line = " ".join(rng.choice(vocabulary) for _ in range(16))
    items = [(i, f"{line} " + " ".join(rng.choice(vocabulary) for _ in range(40))) for i in range(800)]
    items += [(900, items[7][1]), (901, items[7][1].upper())]  # equal words
    texts = [(1, " \n".join([line] * 200)), (2, f"{line} a b c {items[7][1]} {line}"), (3, line)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(make_docs(texts), bench).collect()}
    assert found == {(2, 7), (2, 900), (2, 901)}
    seen = Counter(int(g) for _, t in items for g in np.unique(words.grams(words.hashed_words(t, words.NOT_ALNUM)[0], 5)))
    index = decontam.Index(items, 5, 0.8, seen, len(items))
    started = time.monotonic()
    assert index.matches([texts[0][1]]) == [{}] and time.monotonic() - started < 5


def test_windows_of_more_words_than_two_bytes_count():
    rng = np.random.default_rng(2)
    h = rng.integers(1, 1 << 63, 70_000, np.uint64)
    size = 66_000
    (_, first, found), *_ = [x for x in decontam.simhashes(h, [size])]
    bits = decontam._bits(words.grams(h[first : first + size], 2)).astype(np.int64).sum(0)
    assert found[0] == np.packbits(bits > (size - 1) // 2).view(np.uint64)[0]


def test_many_languages_are_bounded(make_docs, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    rng = random.Random(3)
    usual = [(4 * i, f"{rng.choice(['alpha', 'beta'])} gamma {i}" if i % 2 else f"óx úy {i} éz", "en" if i % 2 else "fr") for i in range(80)]
    junk = [(10_000 + i, f"junk text {i}", f"label{i}") for i in range(300)]
    rows = langid.identify(make_docs([*usual, *junk])).collect()
    assert len(rows) == 380 and {r.lang_pred for r in rows} <= {"en", "fr", "und", *[f"label{i}" for i in range(300)]}
    assert len({r.lang_pred for r in rows}) <= 3 and {r.lang_pred for r in rows if r.doc_id < 400} == {"en", "fr"}


def test_landmarks_share_one_budget(monkeypatch):
    monkeypatch.setattr(langid, "MARKS", 6)
    rows = [(lang, np.packbits(np.eye(1, langid.BUCKETS, 10 * k + j, dtype=np.uint8)[0]).tobytes()) for k, lang in enumerate("abcd") for j in range(5)]
    assert langid.fit(rows)[1].shape[1] == 4


def test_kernel_regression_against_a_dense_solution():
    rng = random.Random(7)
    texts = [("aa", " ".join(rng.choice(["ka", "mo", "ri"]) * rng.randrange(1, 3) for _ in range(12))) for _ in range(12)]
    texts += [("bb", " ".join(rng.choice(["the", "ing", "ock"]) for _ in range(12))) for _ in range(7)]
    rows = list(zip(langid._packed({"lang": [x for x, _ in texts], "text": [t for _, t in texts]})["lang"],
                    langid._packed({"lang": [x for x, _ in texts], "text": [t for _, t in texts]})["bits"], strict=True))
    # Every text is a landmark, so the map spans the whole kernel and the fit is that of the full kernel.
    model = langid.fit(rows, landmarks=100)
    x = np.unpackbits(np.array([np.frombuffer(b, np.uint8) for _, b in sorted(rows)]), axis=1).astype(float)
    kernel = (x @ x.T) / np.sqrt(np.outer(x.sum(1), x.sum(1)))
    label = np.array([lang == "bb" for lang, _ in sorted(rows)]).astype(int)
    weight = 1 / np.bincount(label)[label]
    y = np.where(label[:, None] == [0, 1], 1.0, -1.0)
    # Weighted ridge in the kernel's span with a free offset, solved directly.
    value, vector = np.linalg.eigh(kernel)
    z = np.hstack([vector[:, value > 1e-6] * np.sqrt(value[value > 1e-6]), np.ones((len(x), 1))])
    penalty = langid.RIDGE * np.eye(z.shape[1])
    penalty[-1, -1] = 0
    want = z @ np.linalg.solve(z.T @ (weight[:, None] * z) + penalty, z.T @ (weight[:, None] * y))
    got = (kernel @ np.eye(len(x))) @ np.linalg.lstsq(x / np.sqrt(x.sum(1, keepdims=True)) @ x.T / np.sqrt(x.sum(1)), want - want.mean(0), rcond=None)[0]
    names, marks, weights, offsets = model
    margin = (x @ marks) / np.sqrt(x.sum(1, keepdims=True)) @ weights + offsets
    assert names == ["aa", "bb"] and margin == pytest.approx(want, abs=1e-3) and got.shape == want.shape


def objective(rows, weights, thresholds, levels=3):
    """The penalised likelihood of the ordinal model, written text by text."""
    n = len(rows)
    share = np.bincount([g for g, *_ in rows], minlength=levels) / n
    own = np.array([1 / np.sqrt(share[g]) for g, *_ in rows])
    own /= own.sum()
    used = np.bincount(np.concatenate([np.frombuffer(a, np.int32) for _, a, _ in rows]), minlength=quality.BUCKETS)
    rarity = np.log(n / np.maximum(used, 1)) + 0.05
    shrink = np.where(np.arange(quality.BUCKETS) < quality.FORM_SIDE, quality.SHRINK_WORDS / rarity**quality.RARE, quality.SHRINK_FORMS)
    edge = lambda k, s: 0.0 if k < 0 else 1.0 if k >= levels - 1 else 1 / (1 + np.exp(s - thresholds[k]))
    total = 0.5 * (shrink * weights**2).sum()
    for (g, a, v), w in zip(rows, own, strict=True):
        s = (weights[np.frombuffer(a, np.int32)] * np.frombuffer(v, np.float32)).sum()
        total -= w * np.log(max(edge(g, s) - edge(g - 1, s), 1e-9))
    return total


def test_the_ordinal_fit_is_a_minimum():
    rng = random.Random(2)
    rows = []
    for i in range(90):
        g = i % 3
        text = " ".join(rng.choice([["bad", "ugly", "worse"], ["so", "fair", "plain"], ["fine", "great", "best"]][g] + ["the", "a"]) for _ in range(12))
        at, value = quality.features(text)
        rows.append((g, at.astype(np.int32).tobytes(), value.tobytes()))
    weights, thresholds = quality.fit(rows, steps=400)
    best = objective(rows, weights, thresholds)
    touched = sorted({int(x) for _, a, _ in rows for x in np.frombuffer(a, np.int32)})
    for at in rng.sample(touched, 15):
        step = np.zeros(quality.BUCKETS)
        step[at] = 1e-4
        slope = (objective(rows, weights + step, thresholds) - objective(rows, weights - step, thresholds)) / 2e-4
        assert abs(slope) < 2e-4
    for k in range(2):
        step = np.eye(2)[k] * 1e-4
        slope = (objective(rows, weights, thresholds + step) - objective(rows, weights, thresholds - step)) / 2e-4
        assert abs(slope) < 2e-4
    worse = [objective(rows, weights * scale, thresholds) for scale in (0.5, 0.9, 1.1, 2.0)]
    assert thresholds[0] < thresholds[1] and min(worse) > best and objective(rows, weights * 0, np.array([-0.7, 0.7])) > best


def spark_hash(*values):
    """Spark's xxhash64 of strings or 64-bit integers, one after the other."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64(data, seed=seed).intdigest()
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def test_sketches_are_the_smallest_hashes(spark):
    rng = random.Random(5)
    texts = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(n))) for i, n in enumerate([0, 1, 4, 5, 40, 400, 3000])]
    rows = sketches.with_sketch(spark.createDataFrame(texts, "id long, text string"), "text", "s").collect()
    for r in rows:
        h = [spark_hash(w) for w in r.text.split()]
        found = {spark_hash(*h[i : i + 5]) for i in range(len(h) - 4)} if len(h) >= 5 else {spark_hash(*h)} if h else set()
        assert r.s == sorted(found)[: sketches.SIZE]


def test_crc_of_ids_tells_training_rows():
    assert [zlib.crc32(str(i).encode()) % 4 for i in range(4)] == [1, 3, 1, 3]
