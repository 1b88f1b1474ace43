"""Language identification with string kernels.

A text is the set of its character n-grams of one to three letters (the blended spectrum), lower-cased, with every run
of other characters as one space. N-grams are hashed to `BUCKETS` places. The kernel of two texts counts the
places both have, divided by the root of the product of their set sizes. `landmarks` texts of each language give a
Nyström map of the kernel, kernel ridge regression in that map is fitted one language against the rest, and texts are
scored in batches by two matrix products: presence x landmarks x weights.

Only labelled training rows are learned from: at most `per_language` distinct texts of each language, drawn by a
hash of the text, so the fit is bounded however large the corpus. Of more than `LANGUAGES` values of `lang` those with most
distinct training texts are learned, ties in their order; all together have at most `TRAINING` texts and `MARKS` landmarks (one of
each at least), so labels of any kind bound neither the driver nor the model less. Whole texts are scored, block by block.

A text that is null, empty or has no letter is `und` with score 0. Without any training text all is `und`. Repeated
rows get equal results; other columns are left out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import keep_rows, map_columns, stage

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
PER_LANGUAGE, LANDMARKS, RIDGE = 400, 16, 1e-3
LANGUAGES, TRAINING, MARKS = 100, 8000, 256
#: Code points read at a time, and documents scored in one product.
BLOCK, BATCH = 1 << 18, 32
#: Steepness of the score over the lead of the best language.
STEEP = 6.0
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point of the first plane whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(1 << 16)), bool, 1 << 16)


def _codes(text: str) -> np.ndarray:
    """Code points with non-letters as 0, runs of them as one."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(c, 0xFFFF)
    keep = _letters()[low]
    if (c > 0xFFFF).any():
        keep = np.where(c > 0xFFFF, [chr(x).isalpha() for x in c], keep)
    c = np.where(keep, c, 0)
    if len(c) > 1:
        c = c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]
    return c


def presence(text: str, row: np.ndarray) -> bool:
    """Mark the places of a whole text's n-grams; tells if it has a letter."""
    found, longest = False, max(ORDERS)
    last = np.zeros(1, np.uint32)
    for at in range(0, len(text), BLOCK):
        c = np.concatenate([last, _codes(text[at : at + BLOCK].lower())])
        if at + BLOCK >= len(text):
            c = np.concatenate([c, np.zeros(1, np.uint32)])
        if len(c) > 1:
            c = c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]
        found |= bool(c.any())
        h = c * np.uint32(2654435761)
        for n in ORDERS:
            if len(c) >= n:
                g = h[: len(c) - n + 1] + np.uint32(n * 97)
                for k in range(1, n):
                    g = (g ^ (g >> np.uint32(13))) * np.uint32(2246822519) + h[k : len(c) - n + 1 + k]
                g = (g ^ (g >> np.uint32(15))) * np.uint32(3266489917)
                row[g >> np.uint32(17)] = 1
        last = c[-(longest - 1) :]
    return found


assert BUCKETS == 1 << 32 - 17


def training(docs: DataFrame, held_out: Column, per_language: int) -> DataFrame:
    """lang, bits: at most `per_language` texts of each language, with packed presence.

    Texts are first thinned by a hash to about four times the bound per language, so no language's texts meet in one
    task however many it has. The share follows the number of distinct texts; copies of a text are one row by then."""
    rows = docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.xxhash64("text").alias("h"))
    texts = stage(rows.select("lang", "h").distinct(), "training")
    most = texts.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts = {r["lang"]: r["n"] for r in most.collect()}
    per_language = max(1, min(per_language, TRAINING // max(1, len(counts))))
    if not counts:
        return map_columns(rows.select("lang", "text"), _packed, "lang string, bits binary")
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 4.0 * per_language / n))])
    thin = texts.where(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * float(1 << 30))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    drawn = thin.withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "h")
    # At most per_language keys a language are sent; the copies of a drawn text meet in part before the shuffle.
    kept = rows.join(F.broadcast(drawn), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    return map_columns(kept.select("lang", "text"), _packed, "lang string, bits binary")


def _packed(cols):
    out = {"lang": [], "bits": []}
    for lang, text in zip(cols["lang"], cols["text"], strict=True):
        row = np.zeros(BUCKETS, np.uint8)
        if presence(text, row):
            out["lang"].append(lang)
            out["bits"].append(np.packbits(row).tobytes())
    return out


def fit(rows: list[tuple[str, bytes]], landmarks: int = LANDMARKS, ridge: float = RIDGE):
    """(languages, landmark matrix, weights, offsets) from labelled presence sets; None without any."""
    rows = sorted(rows)
    if not rows:
        return None
    names = sorted({lang for lang, _ in rows})
    landmarks = max(1, min(landmarks, MARKS // len(names)))

    def sets(part: list[tuple[str, bytes]]) -> np.ndarray:
        x = np.unpackbits(np.array([np.frombuffer(b, np.uint8) for _, b in part]), axis=1).astype(np.float32)
        return x / np.sqrt(x.sum(1, keepdims=True))

    label = np.array([names.index(lang) for lang, _ in rows])
    chosen = np.concatenate([np.flatnonzero(label == k)[:landmarks] for k in range(len(names))])
    marks = sets([rows[i] for i in chosen])
    # Unpacked a few at a time.
    kernel = np.concatenate([sets(rows[i : i + BATCH]) @ marks.T for i in range(0, len(rows), BATCH)])
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = value > 1e-6
    root = vector[:, good] / np.sqrt(value[good])
    z = kernel.astype(np.float64) @ root
    # Each language weighs the same, however many texts of it were drawn.
    weight = 1.0 / np.bincount(label)[label]
    y = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    z1 = np.hstack([z, np.ones((len(z), 1))])
    gram = z1.T @ (z1 * weight[:, None]) + ridge * np.diag([1.0] * z.shape[1] + [0.0])
    beta = np.linalg.solve(gram, z1.T @ (y * weight[:, None]))
    return names, marks.T.copy(), (root @ beta[:-1]).astype(np.float32), beta[-1].astype(np.float32)


def scores(texts: list[str | None], model) -> tuple[list[str], list[float]]:
    """Best language and score of each text; a batch of presence rows at a time."""
    names, marks, weights, offsets = model if model else ([], None, None, None)
    langs, best = [UNKNOWN] * len(texts), [0.0] * len(texts)
    for at in range(0, len(texts), BATCH):
        part = texts[at : at + BATCH]
        x = np.zeros((len(part), BUCKETS), np.float32)
        told = [i for i, t in enumerate(part) if t and presence(t, x[i])]
        if not told or not names:
            continue
        x = x[told]
        kernel = (x @ marks) / np.sqrt(x.sum(1, keepdims=True))
        margin = kernel @ weights + offsets
        e = np.exp(STEEP * (margin - margin.max(1, keepdims=True)))
        for i, k, p in zip(told, margin.argmax(1), e.max(1) / e.sum(1), strict=True):
            langs[at + i], best[at + i] = names[k], float(p)
    return langs, best


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the decimal doc_id leaves 2 when divided by 4; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def model_of(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS):
    # At most per_language presence sets of 4 KB a language.
    rows = training(docs, held_out(F.col("doc_id")), per_language).collect()
    return fit([(r["lang"], r["bits"]) for r in rows], landmarks)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns from the rows not held out."""
    sent = docs.sparkSession.sparkContext.broadcast(model_of(docs.select("doc_id", "text", "lang"), per_language, landmarks))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")

    def work(cols):
        langs, best = scores(cols.pop("text"), sent.value)
        return cols | {"lang_pred": langs, "score": best}

    return map_columns(rows, work, "doc_id long, held_out boolean, lang_pred string, score double")


def known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows, whole, whose language is known with a score of at least `least`."""
    sent = docs.sparkSession.sparkContext.broadcast(model_of(docs.select("doc_id", "text", "lang")))
    return keep_rows(docs, ["text"], lambda texts: [s >= least and name != UNKNOWN for name, s in zip(*scores(texts, sent.value), strict=True)])
