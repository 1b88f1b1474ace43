"""BPE encoding of long texts as a tree of joined halves, and decoding.

A long text is cut in halves again and again, at any code point, until pieces are short. Pieces are encoded in
parallel. Two neighbours are joined by encoding anew a window around the cut, which grows until what it says agrees
with both sides:

* at words, until the window starts and ends at a space that starts a pre-token in any context, so the ids
  outside it cannot change;
* in text that has no such space (one endless word), the pre-tokens of both sides and of the joined text are compared.
  Only the one across the cut differs, and windows of its last and first ids grow until the window's own ids begin and
  end with the ids of the sides. A BPE sequence is right when each neighbouring pair of ids is, and every such pair lies
  in a side or in the window, so the result is exact.

Null is taken as an empty text, which has no ids. Repeated rows give repeated results; other columns are left out.
"""

from __future__ import annotations

from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.bytebpe import SAFE, ByteBPE, byte_bpe
from faultline.llm.common import map_columns, small_batches

LEAF = 16_384
#: Code points on each side of a cut and ids on each side of a join in the first window.
WINDOW, IDS = 64, 8


def halves(text: str, leaf: int) -> list[str]:
    """The leaves of a text's tree, left to right."""
    parts = [text]
    while len(parts[0]) > leaf:
        parts = [half for p in parts for half in (p[: (len(p) + 1) // 2], p[(len(p) + 1) // 2 :])]
    return parts


def join_ids(bpe: ByteBPE, left: list[int], right: list[int]) -> list[int]:
    """Ids of one pre-token from those of its two parts."""
    k = IDS
    while True:
        a, b = left[-k:], right[:k]
        window = bpe.model_ids(bpe.mapped(b"".join(bpe.pieces[i] for i in a + b)))
        if (k >= len(left) or window[0] == a[0]) and (k >= len(right) or window[-1] == b[-1]):
            return left[:-k] + window + right[k:]
        k *= 2


def _safe(text: str, last: bool) -> int | None:
    """Place of the last (first) safe space, looked for in growing windows."""
    w = WINDOW
    while True:
        if last:
            found = list(SAFE.finditer(text, max(0, len(text) - w)))
        else:
            found = [m] if (m := SAFE.search(text, 0, w + 1)) and m.end() < len(text) else []
        if found:
            return found[-1].start()
        if w >= len(text):
            return None
        w *= 2


def _count(bpe: ByteBPE, ids: np.ndarray, size: int) -> int:
    """How many ids make up the first `size` bytes."""
    ends = np.cumsum(bpe.lengths[ids]) if len(ids) else np.zeros(0, int)
    k = int(np.searchsorted(ends, size)) + 1 if size else 0
    if size and (k > len(ends) or ends[k - 1] != size):
        raise ValueError("ids do not end where the text was cut")
    return k


def join(bpe: ByteBPE, left: tuple[str, np.ndarray], right: tuple[str, np.ndarray]) -> tuple[str, np.ndarray]:
    """Exact ids of left text + right text, from those of each."""
    (lt, a), (rt, b) = left, right
    if not lt or not rt:
        return (lt + rt, a if lt else b)
    start, end = _safe(lt, True) or 0, _safe(rt, False)
    end = len(rt) if end is None else end
    tail, head = lt[start:], rt[:end]
    a_ids, b_ids = a[::-1], b
    na = _count(bpe, a_ids, len(tail.encode()))
    nb = _count(bpe, b_ids, len(head.encode()))
    keep, rest = a[: len(a) - na], b[nb:]
    if len(tail) + len(head) <= 8 * WINDOW:
        middle = np.frombuffer(bpe.plain(tail + head), np.uint32)
        return lt + rt, np.concatenate([keep, middle, rest])
    split = lambda text: [p for p, _ in bpe.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
    whole, ours, theirs = split(tail + head), split(tail), split(head)
    i = 0
    while i < min(len(whole), len(ours)) and whole[i] == ours[i]:
        i += 1
    j = 0
    while j < min(len(whole) - i, len(theirs)) and whole[-1 - j] == theirs[-1 - j]:
        j += 1
    over, own, other = whole[i : len(whole) - j], ours[i:], theirs[: len(theirs) - j]
    kl = _count(bpe, a[len(a) - na :], sum(map(len, ours[:i])))
    kr = _count(bpe, b[:nb], sum(map(len, other)))
    if len(over) == len(own) == len(other) == 1:
        middle = join_ids(bpe, a[len(a) - na + kl :].tolist(), b[:kr].tolist())
    else:
        middle = [x for p in over for x in bpe.model_ids(p)]
    return lt + rt, np.concatenate([a[: len(a) - na + kl], np.array(middle, np.uint32), b[kr:]])


def join_all(bpe: ByteBPE, nodes: list[tuple[str, np.ndarray]]) -> np.ndarray:
    """Join neighbours level by level up to the root."""
    while len(nodes) > 1:
        nodes = [join(bpe, *nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return nodes[0][1]


def encode(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, ids (binary) of every whole text. Texts of over `leaf` code points go through the tree: their leaves
    are spread over the tasks, and the rows of one text meet again as ids."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def short(cols):
        bpe = byte_bpe(path)
        return {"doc_id": cols["doc_id"], "ids": [bpe.encode(t) for t in cols["text"]]}

    def leaves(cols):
        bpe = byte_bpe(path)
        out = {"row": [], "doc_id": [], "segment": [], "leaf": [], "text": []}
        for row, doc, text in zip(cols["row"], cols["doc_id"], cols["text"], strict=True):
            for s, segment in enumerate(bpe.segments(text)):
                for k, part in enumerate([segment] if s % 2 else halves(segment, leaf)):
                    for name, value in zip(out, (row, doc, s, k, part), strict=True):
                        out[name].append(value)
        return out

    def each(cols):
        bpe = byte_bpe(path)
        special = lambda s, t: array("I", [bpe.special[t]]).tobytes() if s % 2 else bpe.plain(t)
        return cols | {"ids": [special(s, t) for s, t in zip(cols["segment"], cols["text"], strict=True)]}

    def whole(group):
        import pandas as pd

        bpe, found = byte_bpe(path), []
        for _, part in group.sort_values(["segment", "leaf"]).groupby("segment"):
            nodes = [(t, np.frombuffer(x, np.uint32)) for t, x in zip(part["text"], part["ids"], strict=True)]
            found.append(join_all(bpe, nodes).astype("<u4").tobytes())
        return pd.DataFrame({"doc_id": group["doc_id"].iloc[:1], "ids": [b"".join(found)]})

    size = F.char_length("text")
    brief = map_columns(rows.where(size <= leaf), short, "doc_id long, ids binary")
    long = rows.where(size > leaf).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    piece = "row long, doc_id long, segment int, leaf int, text string"
    parts = map_columns(long, leaves, piece).repartition("row", "segment", "leaf")
    joined = map_columns(parts, each, piece + ", ids binary").groupBy("row").applyInPandas(whole, "doc_id long, ids binary")
    return brief.unionByName(joined)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and their text; special tokens stay."""

    def work(cols):
        bpe = byte_bpe(path)
        return cols | {"text": [bpe.decode(x) for x in cols["ids"]]}

    return map_columns(encoded.select("doc_id", "ids"), work, "doc_id long, ids binary, text string")


def decoded_digests(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ids and of what they decode to, in one pass by one worker."""

    def work(cols):
        bpe = byte_bpe(path)
        return _digests(cols | {"text": [bpe.decode(x) for x in cols["ids"]]})

    return map_columns(encoded.select("doc_id", "ids"), work, DIGESTS)


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return map_columns(decoded, _digests, DIGESTS)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(cols):
    import hashlib

    names = _decimals()
    joined = (",".join(map(names.__getitem__, array("I", x))) for x in cols["ids"])
    return {
        "doc_id": cols["doc_id"], "n_tokens": [len(x) // 4 for x in cols["ids"]],
        "ids_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in joined],
        "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in cols["text"]],
    }


class _Decimals(dict):
    def __missing__(self, key: int) -> str:
        self[key] = found = str(key)
        return found


_NAMES = _Decimals()


def _decimals() -> _Decimals:
    return _NAMES
