"""Quality grades by ordinal regression (cumulative link) on hashed text.

A rating is one of the grades 0 to K - 1. One weight vector over hashed text features is shared by all grades and K - 1
ascending thresholds cut its score: P(grade <= k) = sigmoid(threshold[k] - score). Scoring gives the expected grade
and the tail probability P(grade >= `select`), by which documents are kept.

Features of a whole text, over its distinct tokens (pieces between white space):
* for each, its lower-cased word (signs around it stripped) and the first 4, 5 and 6 letters of that word;
* the share of each token form (capital and small letters, digits and signs, runs folded);
* how often a token is repeated on average, in steps of powers of two.
All are hashed to `BUCKETS` weights. A score is then a sum over distinct tokens, so scoring remembers one number
per token.

Fitting reads at most `SAMPLE` rated texts, drawn by a hash of the text, and takes one task; this bound is a
parameter. Everything else covers all rows.

A null or empty text has no features and gets the score of the thresholds alone; ratings that are null are not learned
from. Without any rating, or with ratings of one grade only, the expected grade is null, the tail 1 and all rows are
kept. Repeated doc_ids in the ratings each count. Other columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import keep_rows, map_columns, small_batches

BUCKETS = 1 << 18
SAMPLE, STEPS, LEVELS, RARE, CHUNK = 6000, 200, 3, 2, 128
SHRINK_WORDS, SHRINK_FORMS = 1e-2, 1e-5
FORM_SCALE = 10.0
KEEP = 0.85
#: Tokens remembered in a task, and code points of a text split at a time.
REMEMBERED, BLOCK = 100_000, 1 << 18
BLANK = re.compile(r"\s")
SIGNS = "".join(chr(i) for i in range(33, 128) if not chr(i).isalnum())
PREFIXES = (4, 5, 6)
FORMS = [(re.compile(p), r) for p, r in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0"), ("[^\x00-\x7f]+", "a"), ("a+", "a"))]
FORM_SIDE = BUCKETS - (1 << 12)


def _word_place(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) % FORM_SIDE


def _form_place(text: str) -> int:
    return FORM_SIDE + zlib.crc32(text.encode("utf-8", "replace")) % (BUCKETS - FORM_SIDE)


def places(token: str) -> tuple[list[int], int]:
    """Weight numbers of a token's word and prefixes, and of its form."""
    core = token.lower().strip(SIGNS)
    if token.isalpha() and token.isascii() and (token[1:].islower() or len(token) == 1):
        form = "a" if token[0].islower() else "Aa" if len(token) > 1 else "A"
    else:
        form = token
        for pattern, letter in FORMS:
            form = pattern.sub(letter, form)
    words = [_word_place(core)] + [_word_place(f"{core[:n]}*") for n in PREFIXES if len(core) >= n] if core else []
    return words, _form_place(form)


def tokens(text: str | None) -> tuple[int, set[str]]:
    """(number of tokens, distinct tokens) of a whole text, read in blocks that end between tokens."""
    text, n, found, at = text or "", 0, set(), 0
    while at < len(text):
        blank = BLANK.search(text, at + BLOCK)
        end = blank.start() if blank else len(text)
        part = text[at:end].split()
        n += len(part)
        found.update(part)
        at = end
    return n, found


def repetition(n: int, distinct: int) -> int:
    return _form_place(f"\n{(n // max(distinct, 1)).bit_length()}")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(weight numbers, values) of a whole text."""
    n, found = tokens(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    at, value = [repetition(n, len(found))], [1.0]
    for token in found:
        words, form = places(token)
        at += [*words, form]
        value += [1.0] * len(words) + [FORM_SCALE / len(found)]
    at, back = np.unique(at, return_inverse=True)
    return at, np.bincount(back, value).astype(np.float32)


class TokenScores(dict):
    """What a distinct token adds to a score: words as the real part, its form as the imaginary part."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights, self.numbers = weights, weights.tolist()

    def __missing__(self, token: str) -> complex:
        words, form = places(token)
        value = complex(sum(map(self.numbers.__getitem__, words)), FORM_SCALE * self.numbers[form])
        if len(self) < REMEMBERED:
            self[token] = value
        return value

    def score(self, text: str | None) -> float:
        n, found = tokens(text)
        if not n:
            return 0.0
        total = sum(map(self.__getitem__, found))
        return float(total.real + total.imag / len(found) + self.numbers[repetition(n, len(found))])


def fit(rows: Iterable[tuple[int, bytes, bytes]], steps: int = STEPS, levels: int = LEVELS):
    """(weights, thresholds) from (grade, weight numbers, values); None if fewer than two grades occur.

    Minimises the penalised negative log likelihood; thresholds are a start and positive gaps, so they ascend."""
    grades, sizes, places_seen, values = [], [0], bytearray(), bytearray()
    for g, a, v in rows:
        grades.append(g)
        sizes.append(len(a) // 4)
        places_seen += a
        values += v
    grade = np.array(grades, np.int64)
    if len(np.unique(grade)) < 2:
        return None
    ends, n, texts = np.cumsum(sizes), BUCKETS, len(grades)
    col, val = np.frombuffer(places_seen, np.int32), np.frombuffer(values, np.float32)
    # Features are read a few texts at a time, so the driver holds them once and no product of their size.
    parts = [(i, min(i + CHUNK, texts)) for i in range(0, texts, CHUNK)]

    def owner(i: int, j: int) -> np.ndarray:
        """The text, from 0 on, of each feature of texts i to j - 1."""
        return np.repeat(np.arange(j - i), np.diff(ends[i : j + 1]))

    # A word that most texts have says little, and its weight would grow with a text's length; it is shrunk more.
    rarity = np.log(texts / np.maximum(np.bincount(col, minlength=n), 1)) + 0.05
    shrink = np.where(np.arange(n) < FORM_SIDE, SHRINK_WORDS / rarity**RARE, SHRINK_FORMS)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    cut = lambda t: np.cumsum(np.concatenate([t[:1], np.exp(np.clip(t[1:], -20, 20))]))
    # A rare grade weighs more, by the root of its rarity.
    weight = 1 / np.sqrt(np.bincount(grade, minlength=levels)[grade] / texts)
    weight /= weight.sum()
    high, low = np.minimum(grade, levels - 2), np.maximum(grade - 1, 0)

    def loss(params: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = params[:n], cut(params[n:])
        score = np.concatenate([
            np.bincount(owner(i, j), val[ends[i] : ends[j]] * w[col[ends[i] : ends[j]]], j - i) for i, j in parts])
        up = np.where(grade < levels - 1, sig(b[high] - score), 1.0)
        down = np.where(grade > 0, sig(b[low] - score), 0.0)
        p = np.maximum(up - down, 1e-9)
        d_up, d_down = up * (1 - up) / p * weight, down * (1 - down) / p * weight
        g_cut = np.bincount(high, np.where(grade < levels - 1, -d_up, 0.0), levels - 1)
        g_cut += np.bincount(low, np.where(grade > 0, d_down, 0.0), levels - 1)
        tail = np.cumsum(g_cut[::-1])[::-1]
        d, g_w = d_up - d_down, shrink * w
        for i, j in parts:
            g_w += np.bincount(col[ends[i] : ends[j]], val[ends[i] : ends[j]] * d[i:j][owner(i, j)], n)
        g = np.concatenate([g_w, tail[:1], tail[1:] * np.diff(b)])
        return float(-(weight * np.log(p)).sum() + 0.5 * (shrink * w * w).sum()), g

    # Start at the thresholds that give the grades' shares.
    below = np.clip([(grade <= k).mean() for k in range(levels - 1)], 1e-3, 1 - 1e-3)
    start = np.log(below / (1 - below))
    params = np.concatenate([np.zeros(n), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    params = minimise(loss, params, steps)
    return params[:n].copy(), cut(params[n:])


def minimise(loss, x: np.ndarray, steps: int, memory: int = 10) -> np.ndarray:
    """Limited-memory BFGS with a halving line search."""
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    value, g = loss(x)
    for _ in range(steps):
        d, used = -g, []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            d = d - a * y
            used.append(a)
        if pairs:
            s, y = pairs[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(pairs, reversed(used), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        slope, step = g @ d, 1.0 if pairs else min(1.0, 1.0 / (np.abs(g).sum() + 1e-12))
        while True:
            new_value, new_g = loss(x + step * d)
            if new_value <= value + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, y = step * d, new_g - g
        if s @ y > 1e-12 * (y @ y) and s @ y > 0:
            pairs = [*pairs, (s, y)][-memory:]
        x, done, value, g = x + s, value - new_value < 1e-9 * max(1.0, abs(value)), new_value, new_g
        if done:
            break
    return x


def predict(score: np.ndarray, thresholds: np.ndarray, select: int) -> tuple[np.ndarray, np.ndarray]:
    """(expected grade, tail probability) of scores."""
    over = 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds, -30, 30)))
    return over.sum(1), over[:, select - 1]


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id, grade from the labels: good text that is not toxic is 2, one of both 1, neither 0; a null is no rating."""
    grade = F.col("quality").cast("int") + 1 - F.col("toxic").cast("int")
    return labels.select("doc_id", grade.alias("grade")).where(F.col("grade").between(0, 2))


def model_of(docs: DataFrame, rated: DataFrame, sample: int = SAMPLE):
    """Fit on at most `sample` rated rows of `docs`, drawn by a hash of text and grade."""
    small_batches(docs.sparkSession)
    # Both sides of the join are thinned by the same hash of doc_id; the bound then holds exactly by limit.
    n = rated.count()
    share = min(1.0, 1.5 * sample / max(n, 1))
    thin: Column = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(share * (1 << 30))
    rows = (
        rated.where(thin).select("doc_id", "grade").join(docs.where(thin).select("doc_id", "text"), "doc_id")
        .orderBy(F.xxhash64("doc_id", "text"), "grade").limit(sample).select("grade", "text")
    )

    def work(cols):
        found = [features(t) for t in cols["text"]]
        return {"grade": cols["grade"], "at": [a.astype(np.int32).tobytes() for a, _ in found], "val": [v.tobytes() for _, v in found]}

    drawn = map_columns(rows, work, "grade int, at binary, val binary")
    # Rows come one at a time, in the order of the draw, so the driver holds no second copy of the features.
    return fit((r["grade"], r["at"], r["val"]) for r in drawn.toLocalIterator())


def grade(docs: DataFrame, labels: DataFrame, select: int = 2, keep: float = KEEP) -> DataFrame:
    """doc_id, expected_grade, tail_probability, kept of every row."""
    model = model_of(docs.select("doc_id", "text"), ratings(labels))
    return apply(docs.select("doc_id", "text"), model, select, keep)


def apply(docs: DataFrame, model, select: int = 2, keep: float = KEEP) -> DataFrame:
    """Scores of `docs`; all columns but the text stay."""
    spark = docs.sparkSession
    names = [f for f in docs.schema if f.name != "text"]
    weights, thresholds = model if model else (None, None)
    sent = spark.sparkContext.broadcast(weights)  # BUCKETS numbers, whatever the data

    def ungraded(cols):
        n = len(cols.pop("text"))
        return cols | {"expected_grade": [None] * n, "tail_probability": [1.0] * n, "kept": [True] * n}

    def start():
        if sent.value is None:
            return ungraded
        known = TokenScores(sent.value)

        def work(cols):
            score = np.array([known.score(t) for t in cols.pop("text")])
            mean, tail = predict(score, thresholds, select)
            return cols | {"expected_grade": mean, "tail_probability": tail, "kept": tail >= keep}

        return work

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names)
    return map_columns(docs, start, schema + ", expected_grade double, tail_probability double, kept boolean", per_task=True)


def good(docs: DataFrame, labels: DataFrame, select: int = 2, keep: float = KEEP) -> DataFrame:
    """The rows, whole, whose tail probability reaches `keep`."""
    model = model_of(docs.select("doc_id", "text"), ratings(labels))
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        weights, thresholds = sent.value
        known = TokenScores(weights)
        return lambda texts: (predict(np.array([known.score(t) for t in texts]), thresholds, select)[1] >= keep).tolist()

    return keep_rows(docs, ["text"], start, per_task=True)
