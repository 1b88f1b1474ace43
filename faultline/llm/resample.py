"""Importance resampling towards a target distribution over hashed word runs, scanned by an Aho-Corasick automaton.

Features of a text are all runs of 1 to 3 consecutive words; a run's bucket is the CRC-32 of its words joined by one
space, modulo `buckets`. A bucket's gain says how much more usual it is in the target than in the documents; a
document's weight is the sum of its features' gains, and a Gumbel number drawn from its id makes the highest scores a
sample without replacement that is proportional to the weights' exponentials.

A dictionary of delimiter-bounded words (" word ") feeds the automaton. Each entry carries a payload: the CRC of the word,
the CRC of a space and the word, and the length of both. A scan over blocks of text emits payload numbers; the CRC of a
longer run is composed from the payloads of neighbours (the first CRC moved on by the second's length, exclusive-or the
second's CRC), so no run is ever built as a string. The automaton has at most the `DICTIONARY` words that occur most often in
documents and target, counted over all of them; a word that it lacks shows as a gap between two emitted matches, gets a
payload of its own once per batch and takes part in the same composition. So every word counts, whatever the
dictionary holds.

Words are runs of ASCII letters and digits and of characters beyond ASCII; A-Z are lower-cased, nothing else. A null or
empty text, or one without words, has no features and weight 0. A row with a null doc_id has a null score, does not count
among those drawn from and is never drawn. Rows that share a doc_id are scored and drawn each on their own; equal ones
take neighbouring ranks. An empty target has T = 0; the formula holds. Very long texts are scanned in blocks of
`BLOCK` bytes cut between words, the last two words going along; a single longer word is kept whole. Other columns are
left out.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import small_batches, stage
from faultline.operators.numbering import number_rows

BUCKETS, RUN, SEED = 10_000, 3, 42
#: Words in the automaton and the longest of them in bytes; both bound what is sent to the tasks.
DICTIONARY, LONGEST = 50_000, 64
#: Classes of word counts for each doubling.
LEVELS = 16
#: Bytes of text scanned at a time, and distinct words counted in a task before they are passed on.
BLOCK, COUNTED = 1 << 20, 100_000
_SPACE = ord(" ")
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() or b > 127 else _SPACE for b in range(128)) + bytes(range(128, 256))


def _shift_tables(lengths: int) -> np.ndarray:
    """tables[n, k, b]: the CRC whose byte k is b, moved on by n zero bytes."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    tables = np.zeros((lengths, 4, 256), np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(1, lengths):
        tables[n] = one[tables[n - 1] & 0xFF] ^ (tables[n - 1] >> 8)
    return tables


_LENGTHS = 257
_SHIFT = _shift_tables(_LENGTHS)


def moved(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs moved on by so many zero bytes."""
    flat, out, left = _SHIFT.reshape(-1), crc.astype(np.uint32), length.astype(np.int64)
    top = _LENGTHS - 1
    while len(left) and left.max() > top:
        far = np.flatnonzero(left > top)
        out[far] = moved(out[far], np.full(len(far), top))
        left[far] -= top
    at = left * 1024
    return flat[at + (out & 0xFF)] ^ flat[at + 256 + ((out >> 8) & 0xFF)] ^ flat[at + 512 + ((out >> 16) & 0xFF)] ^ flat[at + 768 + (out >> 24)]


class Payloads:
    """CRC of each word, CRC of a space and the word, and the length of both; the number of an entry is its payload."""

    def __init__(self, words: list[bytes]):
        self.plain = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.spaced = np.array([zlib.crc32(b" " + w) for w in words], np.uint32)
        self.length = np.array([len(w) + 1 for w in words], np.int64)


def automaton(words: list[bytes]):
    """The automaton of the words between delimiters; bytes stand as characters of the same number."""
    import ahocorasick

    built = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, word in enumerate(words):
        built.add_word(f" {word.decode('latin-1')} ", i)
    if words:
        built.make_automaton()
    return built


def pieces(texts: list[bytes | None]) -> Iterator[list[tuple[int, bytes]]]:
    """Blocks of (text number, normalised words joined by one space), each of about `BLOCK` bytes."""
    block, size = [], 0
    for i, text in enumerate(texts):
        at, n = 0, len(text or b"")
        while at < n:
            end = min(at + BLOCK, n)
            part = text[at:end].translate(_FOLD)
            while end < n and part[-1] != _SPACE and text[end : end + 1].translate(_FOLD) != b" ":
                # Cut behind the last whole word; a word longer than a block is read on.
                cut = part.rfind(b" ")
                if cut >= 0:
                    end, part = at + cut + 1, part[: cut + 1]
                else:
                    more = text[end : end + BLOCK].translate(_FOLD)
                    stop = more.find(b" ")
                    more = more if stop < 0 else more[:stop]
                    part, end = part + more, end + len(more)
            at = end
            words = b" ".join(part.split())
            if words:
                block.append((i, words))
                size += len(words)
            if size >= BLOCK:
                yield block
                block, size = [], 0
    if block:
        yield block


class Scanner:
    """Scans texts for the buckets of their word runs."""

    def __init__(self, words: list[bytes], buckets: int = BUCKETS, run: int = RUN):
        self.automaton, self.payloads, self.empty = automaton(words), Payloads(words), not words
        self.buckets, self.run = buckets, run

    def emitted(self, block: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, Payloads]:
        """(owner, payload number of each word in order, payloads of the words that the dictionary lacks)."""
        text = "".join(f"\n {words.decode('latin-1')} " for _, words in block)
        starts = np.cumsum([0] + [len(words) + 3 for _, words in block])
        hits = np.fromiter(() if self.empty else self.automaton.iter(text), np.dtype([("end", np.int64), ("at", np.int64)]))
        end, at = hits["end"].copy(), hits["at"].copy()
        begin = end - self.payloads.length[at]
        # Between two neighbours there is one shared space; anything else between them holds unknown words.
        left, right = np.r_[0, end], np.r_[begin, len(text)]
        rest: dict[str, int] = {}
        new_at, new_end, n = [], [], len(self.payloads.plain)
        for a, b in zip(*(x[right > left].tolist() for x in (left, right)), strict=True):
            place = a
            for word in text[a:b].split(" "):
                if word.strip("\n"):
                    new_at.append(n + rest.setdefault(word, len(rest)))
                    new_end.append(place + len(word))
                place += len(word) + 1
        if new_at:
            order = np.argsort(np.r_[end, new_end], kind="stable")
            end, at = np.r_[end, new_end].astype(np.int64)[order], np.r_[at, new_at].astype(np.int64)[order]
        owner = np.array([i for i, _ in block], np.int64)[np.searchsorted(starts, end, "right") - 1]
        return owner, at, Payloads([w.encode("latin-1") for w in rest])

    def scan(self, texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words in a run, text numbers, buckets) of all runs of that size, block after block."""
        back = self.run - 1
        kept = [np.zeros(0, t) for t in (np.int64, np.uint32, np.uint32, np.int64)]
        for block in pieces(texts):
            owner, at, rest = self.emitted(block)
            fresh = [np.r_[getattr(self.payloads, n), getattr(rest, n)][at] for n in ("plain", "spaced", "length")]
            old = len(kept[0])
            owner, plain, spaced, length = (np.r_[a, b] for a, b in zip(kept, [owner, *fresh], strict=True))
            crc = plain
            for words in range(1, self.run + 1):
                # crc[i]: the run of so many words that ends at word i + words - 1.
                ends = np.arange(words - 1, len(owner))
                good = (ends >= old) & (owner[ends] == owner[ends - words + 1])
                yield words, owner[ends[good]], (crc[good] % self.buckets).astype(np.int64)
                if words < self.run:
                    crc = moved(crc[:-1], length[words:]) ^ spaced[words:] if len(crc) > 1 else crc[:0]
            kept = [x[max(0, len(owner) - back) :] for x in (owner, plain, spaced, length)]


def _binary(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.names.index(name)).cast(pa.binary()).to_pylist()


def word_counts(texts: DataFrame) -> DataFrame:
    """word (bytes of at most LONGEST), n over all rows of a `text` column."""
    small_batches(texts.sparkSession)

    def count(batches):
        def out():
            words = [w for w in found if len(w) <= LONGEST]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([found[w] for w in words], pa.int64())], ["word", "n"])

        found: Counter[bytes] = Counter()
        for batch in batches:
            for block in pieces(_binary(batch, "text")):
                for _, words in block:
                    found.update(words.split(b" "))
                if len(found) > COUNTED:
                    yield out()
                    found.clear()
        yield out()

    return texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, target: DataFrame, words: int = DICTIONARY) -> list[bytes]:
    """At most so many of the words that occur most often in both tables.

    Words are classed by the logarithm of their counts, and whole classes are taken from the top while they fit; so the driver
    sees one row per class and the taken words, however many parts the table has."""
    level = F.floor(F.log2("n") * LEVELS)
    counted = stage(word_counts(docs.select("text").union(target.select("text"))).withColumn("level", level), "word-counts")
    sizes = {r.level: r["count"] for r in counted.groupBy("level").count().collect()}
    least, room = None, words
    for found in sorted(sizes, reverse=True):
        room -= sizes[found]
        if room < 0:
            break
        least = found
    return [] if least is None else sorted(bytes(r.word) for r in counted.where(F.col("level") >= least).select("word").collect())


def bucket_counts(texts: DataFrame, words: list[bytes], buckets: int = BUCKETS, run: int = RUN) -> list[int]:
    """How many features of all rows fall into each bucket."""
    small_batches(texts.sparkSession)
    sent = texts.sparkSession.sparkContext.broadcast(words)

    def count(batches):
        scanner, total = Scanner(sent.value, buckets, run), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, bucket in scanner.scan(_binary(batch, "text")):
                total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    found = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for r in found.collect():  # one row per bucket
        out[r.bucket] = r.n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """Gain of each bucket from the counts of documents and target."""
    n, s_all, t_all = len(source), float(sum(source)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source, target, strict=True)]


def gumbel(doc_id: int, seed: int) -> int:
    """A repeatable Gumbel number of a document, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, words: list[bytes], gain: list[int], seed: int = SEED, run: int = RUN) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((words, np.array(gain, np.float64)))
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "n_features", "weight", "score")])

    def weigh(batches):
        known, gain = sent.value
        scanner = Scanner(known, len(gain), run)
        for batch in batches:
            n = batch.num_rows
            total, features, words = (np.zeros(n, np.int64) for _ in range(3))
            for size, owner, bucket in scanner.scan(_binary(batch, "text")):
                # Sums of whole numbers far below 2^53 are exact.
                total += np.bincount(owner, gain[bucket], n).astype(np.int64)
                found = np.bincount(owner, minlength=n)
                features += found
                if size == 1:
                    words += found
            ids = batch.column(batch.schema.names.index("doc_id")).to_pylist()
            score = [None if d is None else int(w) + gumbel(d, seed) for d, w in zip(ids, total, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, words, features, total, score)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        weigh, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = SEED, buckets: int = BUCKETS,
             run: int = RUN, words: int = DICTIONARY) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null if not drawn) of every row of `docs`.

    Of the N rows with at least `least_words` words the floor(percent * N / 100) highest scores are drawn, ties to the
    smaller doc_id."""
    known = dictionary(docs, target, words)
    gain = gains(*(bucket_counts(texts, known, buckets, run) for texts in (docs, target)))
    rows = stage(weighed(docs, known, gain, seed, run), "weighed")
    able = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    drawn = percent * rows.where(able).count() // 100
    order = [F.when(able, 0).otherwise(1), F.desc("score"), F.col("doc_id"), F.col("n_features"), F.col("n_words")]
    ranked = number_rows(rows, order, "rank")
    return ranked.withColumn("rank", F.when(able & (F.col("rank") <= drawn), F.col("rank")))


def drawn(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = SEED) -> DataFrame:
    """The rows, whole, of the drawn documents; of rows that share a doc_id all are returned if one is drawn."""
    ids = resample(docs, target, percent, least_words, seed).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, F.col("doc_id") == F.col("_drawn"), "left_semi")
