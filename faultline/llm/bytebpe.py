"""Byte-level BPE as the tokenizers library does it.

The library splits a text into pre-tokens and runs its BPE model in each of them on its own. A single space with a
non-space on both sides always starts a pre-token, whatever stands around it, so a text may be cut there. Pieces of
ASCII and Latin letters are merged by tiktoken, four times faster, under the ranks of the same vocabulary file; pieces
with other characters, whose classes could differ between the two libraries, go to the tokenizers library.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from itertools import groupby

import numpy as np

#: A space that starts a pre-token in any context.
SAFE = re.compile(r"(?<=\S) (?=\S)")
LATIN_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Texts of these characters alone are split alike by both libraries.
NOT_LATIN = re.compile(rf"[^\t-\r -~{LATIN_LETTERS}]")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself,
    the others take the code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder for one tokenizer file; ids are little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        step = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or step.get("type") != "ByteLevel" or step.get("add_prefix_space") or not step["use_regex"]:
            raise ValueError("a byte-level tokenizer without normalizer or added spaces is needed")
        self.model = self.tokenizer.model
        shown = byte_characters()
        self.shown = {b: ord(c) for b, c in shown.items()}
        back = {c: b for b, c in shown.items()}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces = [b""] * size
        for word, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.pieces[i] = bytes(back[c] for c in word) if all(c in back for c in word) else word.encode()
        self.lengths = np.array([len(p) for p in self.pieces])
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        ranks = {self.pieces[i]: i for word, i in spec["model"]["vocab"].items()}
        merged = [self.pieces[i] for i in range(256, 256 + len(spec["model"]["merges"]))]
        self.ranked = None
        if merged == [b"".join(bytes(back[c] for c in w) for w in pair) for pair in spec["model"]["merges"]]:
            self.ranked = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def segments(self, text: str) -> list[str]:
        """The text cut at special tokens, which the library takes out first; these stand at odd places."""
        if self.at_special is None or not any(s in text for s in self.special):
            return [text]
        return self.at_special.split(text)

    def mapped(self, data: bytes) -> str:
        return data.decode("latin-1").translate(self.shown)

    def model_ids(self, shown: str) -> list[int]:
        """BPE of one pre-token, given in byte characters."""
        return [t.id for t in self.model.tokenize(shown)]

    def ranked_ids(self, text: str) -> bytes:
        return array("I", self.ranked.encode_ordinary(text)).tobytes()

    def library_ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if self.ranked is None:
            return self.library_ids(text)
        if text.isascii() or not NOT_LATIN.search(text):
            return self.ranked_ids(text)
        pieces = SAFE.split(text)
        pieces[1:] = [" " + p for p in pieces[1:]]
        runs = groupby(pieces, lambda p: bool(NOT_LATIN.search(p)))
        return b"".join((self.library_ids if odd else self.ranked_ids)("".join(run)) for odd, run in runs)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text; null is an empty text."""
        parts = self.segments(text or "")
        if len(parts) == 1:
            return self.plain(parts[0])
        return b"".join(array("I", [self.special[p]]).tobytes() if i % 2 else self.plain(p) for i, p in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, as in the library."""
        return b"".join(map(self.pieces.__getitem__, array("I", ids))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBPE:
    """One encoder per worker and file."""
    return ByteBPE(path)
