"""Words of whole texts as hashes, found in the UTF-8 bytes with numpy. A-Z are lower-cased, nothing else."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Bytes of one array operation.
BLOCK = 256 << 10
_RNG = np.random.Generator(np.random.PCG64(20240101))
_TABLE = _RNG.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


class Separators:
    """Which bytes stand between words; the rest of a text is words."""

    def __init__(self, pattern: bytes):
        self.pattern = re.compile(pattern)
        self.table = np.array([bool(self.pattern.fullmatch(bytes([b]))) for b in range(256)])


BLANKS = Separators(rb"[\x20\x09-\x0D]")
NOT_ALNUM = Separators(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, enough for a block."""
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        n = max(n, 1 << 16, min(2 * len(_POWERS), BLOCK))
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE, np.uint64)], dtype=np.uint64)
            _INVERSE = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, pow(_BASE, -1, 1 << 64), np.uint64)], dtype=np.uint64)
    return _POWERS, _INVERSE


def _blocks(data: bytes, sep: Separators) -> Iterator[tuple[int, int]]:
    at, n = 0, len(data)
    while at < n:
        end = min(at + BLOCK, n)
        if end < n:
            found = sep.pattern.search(data, end)
            end = found.start() if found else n
        yield at, end
        at = end


def hashed_words(text: str | None, sep: Separators) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(hashes, start bytes, end bytes, the lower-cased bytes) of a whole text's words, in order."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    hashes, starts, ends = [], [], []
    for at, end in _blocks(data, sep):
        raw = np.frombuffer(data, np.uint8, end - at, at)
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = ~sep.table[raw]
        edge = np.diff(inside)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(s):
            continue
        power, inverse = _powers(len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_TABLE[raw] * power[: len(raw)], out=total[1:])
        h = (total[e] - total[s]) * inverse[s]
        hashes.append(mix(h + (e - s).astype(np.uint64)))
        starts.append(s + at)
        ends.append(e + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), data
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends), data


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that start at each word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n]
    return mix(out)


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; fewer words are one shingle, no words none."""
    if 0 < len(hashes) < k:
        return grams(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return np.unique(grams(hashes, k))
