"""Benchmark passages in documents, by SimHash of item-sized windows.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. An item of n words is looked for by four
probes: the windows at its start and end of the largest window size not above n, and of that not above n / 2; sizes
grow by the root of two. So each item has windows of nearly its own size, and one changed word leaves a probe whole.
Spread edits touch all four and move their bits too far, so all windows of one shorter size, one at each word of the
item, are probes as well, which must agree in all bits. That size is the largest for which a copy in order that reaches
`least` must hold one whole: its lost shingles are too few to break every run (`run_size`).
Every window of these sizes in every document gets a 64-bit SimHash of its word pairs. The bits are indexed in
RADIUS + 1 blocks: a window within RADIUS bits of a probe agrees with it in a whole block, so none is missed. Candidates
are then compared exactly, each at all places between those its windows point to, as inserted and dropped words shift
them: the weight of the item's shingles of `k` words found at that place, over the weight of all,
must reach `least`. A shingle weighs more the fewer items have it.

A line that many items share makes a candidate of each item at each of its places. Few of them are compared: an item's rarest
shingles, enough of them that without any the rest cannot reach `least`, are looked up in the text, and a candidate without one
near it cannot match. This is decided for whole arrays of candidates, at most `PAIRS` at a time. Items of equal words are one.

The index of the benchmark is sent to all tasks, `ITEM_WORDS` words of items at a time; a larger benchmark takes
more passes over the documents. Items with fewer words than a shingle are one shingle. Items or texts that are null or
without words match nothing; repeated items and rows match each on their own. Very long texts are searched whole, window sizes in
blocks of words; their word hashes are held. A null doc_id or item_id is given back as null; other columns are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import keep_rows, map_columns, small_batches, stage
from faultline.llm.words import NOT_ALNUM, grams, hashed_words

RADIUS = 5
LEAST = 0.8
#: Words of one array operation, words around a place that still count as found there, words of items in one pass.
BLOCK, AROUND, ITEM_WORDS = 8192, 2, 1_000_000
#: Pairs of a window and a probe in one array operation.
PAIRS = 1 << 20
SIZES = sorted({round(2 ** (j / 2)) for j in range(1, 41)} | {1})


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)


def simhashes(h: np.ndarray, sizes: list[int]):
    """(size, first window, fingerprints of all windows) over word hashes, in blocks."""
    top = max(sizes)
    for at in range(0, len(h), BLOCK):
        part = h[at : at + BLOCK + top - 1]
        for k in {min(s, 2) for s in sizes}:
            g = grams(part, k)
            if not len(g):
                continue
            # Differences of sums that wrap are right while a window has fewer words than the type's range.
            kind = np.uint16 if top < 1 << 16 else np.uint32
            total = np.zeros((len(g) + 1, 64), kind)
            np.cumsum(_bits(g), axis=0, dtype=kind, out=total[1:])
            for size in (s for s in sizes if min(s, 2) == k):
                m = size - k + 1
                n = min(len(total) - m, BLOCK)
                if n > 0:
                    ones = total[m : m + n] - total[:n]
                    yield size, at, np.packbits(ones > m // 2, axis=1).view(np.uint64).ravel()


def most_found(weights: list[float], longest: int, k: int) -> float:
    """The most weight of shingles found in order without a run of more than `longest`; a break loses k - 1 of them."""
    if longest < 1:
        return 0.0
    total, best, ended = 0.0, 0.0, []
    ahead: list[float] = []  # for each start of a run, the most before it less all weight before it
    for j, weight in enumerate([*weights, 0.0]):
        if j:
            ended.append(total + max(ahead[-longest:]))
        if j >= k:
            best = max(best, ended[j - k])
        ahead.append(best - total)
        total += weight
    return max(ended)


def run_size(weights: list[float], n: int, k: int, needed: float) -> int:
    """The largest window of an item of n words that a copy with shingles of weight `needed` must hold whole somewhere.

    `weights` are those of all its shingles in order; a repeated one counts at each place, so the size errs to the small."""
    for size in reversed([s for s in SIZES if s <= n]):
        if size <= k or most_found(weights, size - k, k) < needed - 1e-9:
            return size
    return 1


def expanded(some: np.ndarray, low: np.ndarray, count: np.ndarray):
    """(some[i], each of low[i] ... low[i] + count[i] - 1), at most about PAIRS at a time."""
    ends = np.cumsum(count)
    at = 0
    while at < len(some):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = count[at:end]
        yield np.repeat(some[at:end], n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at:end], n)
        at = end


class Index:
    """Probes of some items and the items' weighted shingles."""

    def __init__(self, items: list[tuple[int | None, str]], k: int, least: float, seen: dict[int, int], n_items: int):
        #: For each text: all its ids, number of words, distinct shingles and their weights.
        self.k, self.least, self.items = k, least, []
        probes: dict[int, set[tuple[int, int, int]]] = {}
        runs: dict[int, list[tuple[np.ndarray, int]]] = {}
        rare: dict[int, list[tuple[np.ndarray, int]]] = {}
        same: dict[bytes, list[int | None]] = {}
        for item_id, text in items:
            h = hashed_words(text, NOT_ALNUM)[0]
            if not len(h):
                continue
            if h.tobytes() in same:
                same[h.tobytes()].append(item_id)
                continue
            ids = same[h.tobytes()] = [item_id]
            own, place = np.unique(grams(h, min(k, len(h))), return_inverse=True)
            weights = np.log1p([n_items / seen.get(int(g), 1) for g in own])
            number = len(self.items)
            self.items.append((ids, len(h), own, weights))
            heavy = np.argsort(-weights, kind="stable")
            enough = int(np.searchsorted(np.cumsum(weights[heavy]), (1 - least) * weights.sum() + 1e-9, "right")) + 1
            rare.setdefault(min(k, len(h)), []).append((own[heavy[:enough]], number))
            size = run_size(weights[place].tolist(), len(h), min(k, len(h)), least * weights.sum())
            runs.setdefault(size, []).append((np.concatenate([f for _, _, f in simhashes(h, [size])]), number))
            for limit in {len(h), max(1, len(h) // 2)}:
                size = max(s for s in SIZES if s <= limit)
                for offset in {0, len(h) - size}:
                    found = next(simhashes(h[offset : offset + size], [size]))[2][0]
                    probes.setdefault(size, set()).add((int(found), number, offset))
        self.rare = {}
        for size, parts in rare.items():
            found = np.concatenate([g for g, _ in parts])
            order = np.argsort(found, kind="stable")
            known = np.zeros(1 << 16, bool)
            known[(found >> np.uint64(48)).astype(np.int64)] = True
            self.rare[size] = (found[order], np.repeat([i for _, i in parts], [len(g) for g, _ in parts])[order], known)
        self.words = np.array([n for _, n, _, _ in self.items], np.int64)
        edges = np.linspace(0, 64, RADIUS + 2).round().astype(int)
        self.sizes, self.probes, self.runs = sorted({*probes, *runs}), {}, {}
        for size, parts in runs.items():
            fp = np.concatenate([f for f, _ in parts])
            order = np.argsort(fp, kind="stable")
            number = np.repeat([i for _, i in parts], [len(f) for f, _ in parts])
            offset = np.concatenate([np.arange(len(f)) for f, _ in parts])
            known = np.zeros(1 << 16, bool)
            known[(fp >> np.uint64(48)).astype(np.int64)] = True
            self.runs[size] = (fp[order], number[order], offset[order], known)
        for size, found in probes.items():
            rows = sorted(found)
            fp = np.array([r[0] for r in rows], np.uint64)
            blocks = []
            for low, high in zip(edges, edges[1:], strict=False):
                value = self._block(fp, low, high)
                blocks.append((low, high, np.argsort(value, kind="stable"), np.searchsorted(np.sort(value), np.arange((1 << int(high - low)) + 1))))
            self.probes[size] = (fp, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), blocks)

    @staticmethod
    def _block(fp: np.ndarray, low: int, high: int) -> np.ndarray:
        return ((fp >> np.uint64(low)) & np.uint64((1 << int(high - low)) - 1)).astype(np.int64)

    def pointed(self, h: np.ndarray):
        """(item numbers, words at which they would start) for windows within the radius of a probe, or equal to a run."""
        for size, first, fps in simhashes(h, self.sizes):
            if size in self.runs:
                run_fp, item, offset, known = self.runs[size]
                some = np.flatnonzero(known[(fps >> np.uint64(48)).astype(np.int64)])
                low = np.searchsorted(run_fp, fps[some], "left")
                count = np.searchsorted(run_fp, fps[some], "right") - low
                for window, run in expanded(some, low, count):
                    yield item[run], first + window - offset[run]
            if size not in self.probes:
                continue
            probe_fp, item, offset, blocks = self.probes[size]
            for low, high, order, pointer in blocks:
                value = self._block(fps, low, high)
                start, count = pointer[value], pointer[value + 1] - pointer[value]
                some = np.flatnonzero(count)
                for window, at in expanded(some, start[some], count[some]):
                    probe = order[at]
                    near = np.bitwise_count(fps[window] ^ probe_fp[probe]) <= RADIUS
                    yield item[probe[near]], first + window[near] - offset[probe[near]]

    def rare_places(self, h: np.ndarray) -> np.ndarray:
        """item * (words + 1) + word of every place at which one of an item's rarest shingles stands, ascending."""
        out = [np.zeros(0, np.int64)]
        for size, (found, item, known) in self.rare.items():
            g = grams(h, size)
            some = np.flatnonzero(known[(g >> np.uint64(48)).astype(np.int64)])
            low = np.searchsorted(found, g[some], "left")
            count = np.searchsorted(found, g[some], "right") - low
            out += [item[at] * (len(h) + 1) + word for word, at in expanded(some, low, count)]
        return np.sort(np.concatenate(out))

    def candidates(self, h: np.ndarray) -> list[tuple[int, int]]:
        """(item number, word at which it would start), ascending, of the places pointed to that can match.

        What stands between two places of an item is compared too, so a rare shingle counts within that reach."""
        if not self.sizes or not len(h):
            return []
        rare, kept = None, []
        for number, start in self.pointed(h):
            if not len(number):
                continue
            rare = self.rare_places(h) if rare is None else rare
            n = self.words[number]
            reach = np.maximum(AROUND, n // 4) + AROUND
            row = number * (len(h) + 1)
            low = np.searchsorted(rare, row + np.clip(start - reach, 0, len(h)), "left")
            high = np.searchsorted(rare, row + np.clip(start + n + reach, 0, len(h)), "right")
            good = high > low
            if good.any():
                kept.append(np.unique(np.stack([number[good], start[good]], 1), axis=0))
        return [tuple(x) for x in np.unique(np.concatenate(kept), axis=0).tolist()] if kept else []

    def places(self, h: np.ndarray):
        """The candidates in order, and the places between two of an item that shifts by a few words can join."""
        last: dict[int, int] = {}
        for number, start in self.candidates(h):
            before = last.get(number)
            if before is not None and 1 < start - before <= max(AROUND, self.items[number][1] // 4):
                for between in range(before + 1, start):
                    yield number, between
            last[number] = start
            yield number, start

    def matches(self, texts: list[str | None]) -> list[dict[int, tuple[float, int]]]:
        """For each text {item number: (similarity, start word)} at its best place."""
        hashes = [hashed_words(t, NOT_ALNUM)[0] for t in texts]
        ends = np.cumsum([len(h) for h in hashes])
        together = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        out: list[dict[int, tuple[float, int]]] = [{} for _ in texts]
        for number, start in self.places(together):
            _, n, own, weights = self.items[number]
            # The place may stick out at an end; it belongs to the text that holds its middle.
            row = int(np.searchsorted(ends, min(max(start + n // 2, 0), len(together) - 1), "right"))
            low, high = int(ends[row]) - len(hashes[row]), int(ends[row])
            part = together[max(low, start - AROUND) : min(high, start + n + AROUND)]
            found = np.isin(own, grams(part, min(self.k, n)))
            similarity = float(weights[found].sum() / weights.sum())
            best = (similarity, -(start - low))
            if similarity >= self.least - 1e-12 and best > out[row].get(number, (0.0, 0)):
                out[row][number] = best
        return [{i: (s, max(0, -at)) for i, (s, at) in sorted(found.items())} for found in out]


def indexes(benchmark: DataFrame, k: int, least: float):
    """Indexes of all items, a bounded piece of the benchmark each."""
    spark = benchmark.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size, n = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    pieces = max(1, -(-(size or 0) // (4 * ITEM_WORDS)))

    def counted(cols):
        out = []
        for text in cols["text"]:
            h = hashed_words(text, NOT_ALNUM)[0]
            out += np.unique(grams(h, min(k, len(h)))).view(np.int64).tolist() if len(h) else []
        return {"gram": out}

    shared = stage(map_columns(items.select("text"), counted, "gram long").groupBy("gram").count().where("count > 1"), "shared")
    for piece in range(pieces):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(pieces)) == piece).collect()
        texts = [(r["item_id"], r["text"]) for r in rows]
        wanted = counted({"text": [t for _, t in texts]})["gram"]
        found = spark.createDataFrame([(g,) for g in set(wanted)], "gram long")
        seen = {r["gram"] % (1 << 64): r["count"] for r in shared.join(found, "gram").collect()}
        yield Index(texts, k, least, seen, n)


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = LEAST) -> DataFrame:
    """doc_id, item_id, similarity, start_word (words from 0), item_words of every passage found."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, similarity double, start_word long, item_words long"
    out = spark.createDataFrame([], schema)
    for index in indexes(benchmark, k, least):
        sent = spark.sparkContext.broadcast(index)

        def work(cols, sent=sent):
            rows = {n: [] for n in ("doc_id", "item_id", "similarity", "start_word", "item_words")}
            for doc, found in zip(cols["doc_id"], sent.value.matches(cols["text"]), strict=True):
                for number, (similarity, start) in found.items():
                    ids, words = sent.value.items[number][:2]
                    for item in ids:
                        for name, value in zip(rows, (doc, item, similarity, start, words), strict=True):
                            rows[name].append(value)
            return rows

        out = out.union(map_columns(docs.select(F.col("doc_id").cast("long"), "text"), work, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = LEAST) -> DataFrame:
    """The rows, whole, in which no item is found."""
    spark = docs.sparkSession
    for index in indexes(benchmark, k, least):
        sent = spark.sparkContext.broadcast(index)
        docs = keep_rows(docs, ["text"], lambda texts, sent=sent: [not found for found in sent.value.matches(texts)])
    return docs
