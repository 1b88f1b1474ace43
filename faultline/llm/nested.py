"""Secrets in texts and in what texts wrap, layer by layer.

A worklist begins with the text. Each layer is searched for the three kinds of secrets, then unwrapped:
* percent escapes and Unicode escapes (`\\u0041`, `\\U00000041`, `\\x41`, `&#65;`, `&#x41;`) of a whole layer give one
  new layer each, in which what stands around an escape is kept;
* every run of base64 (both alphabets, at least `RUN` characters) that decodes to readable text, and every one or every run of
  byte escapes that decodes to gzip, zlib, bzip2, xz or zstandard data, gives a layer of its own.
New layers are searched and unwrapped in turn until nothing is left to unwrap. A layer of the same content and from the same
place as an earlier one is not followed again: escapes may be undone in several orders, and a compressed file can unpack to itself. Each layer knows where its characters came
from, so a find is given as a span of the original text: the characters it was unwrapped from, or the whole run when
it was compressed.

The search of the text itself is the base; finds of deeper layers are added, once per kind and span. Spans are code
points, end exclusive.

A null or empty text has no spans. Rows are treated each on their own, so ties and repeated rows need no rule; texts
are searched whole. Compressed data are unpacked in pieces of `PIECE` bytes cut where no find can reach across, so a small run that
unpacks to a large text takes bounded memory; chains of layers that keep growing without repeating end when a text has
unpacked to over `GROWTH` times its size (one layer of gzip cannot), which `whole` then tells.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import small_batches

# The three kinds in order, and the smallest sizes of a find.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST = 8
# Runs are taken whole, so asking for the smallest size at once finds the same ones.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
BYTES = re.compile(r"(?:\\x[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|(?:\\x[0-9A-Fa-f]{2})+")
RUN = 16
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Bytes unpacked at a time; growth of a text at which chains of layers end.
PIECE, GROWTH = 4 << 20, 2000
#: Characters that no find and no wrapped run contains.
APART = [bytes([b]) for b in b"\n\t,(){}<>!?|~^*"]
MAGIC = (b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd")
SPAN = "struct<kind: string, start: long, end: long, layers: string, secret: string>"


def search(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of the finds of one layer."""
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= ASSIGN_LEAST:
            yield 0, m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            yield 1, m.start(), m.end()
    for m in HEX.finditer(text):
        yield 2, m.start(), m.end()


class Origin:
    """Where the characters of a layer came from in the layer above."""

    def span(self, start: int, end: int) -> tuple[int, int]:
        raise NotImplementedError


class Whole(Origin):
    """Everything came from one run."""

    def __init__(self, start: int, end: int):
        self.at = (start, end)

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self.at


class Quads(Origin):
    """Three bytes from four characters of base64; `steps` are the byte places of the characters, None if each is one byte."""

    def __init__(self, start: int, end: int, text: str):
        self.start, self.end, self.text = start, end, None if text.isascii() else text

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.text is not None:
            start, end = len(self.text[:start].encode()), len(self.text[:end].encode())
        last = (end - 1) // 3 * 4 + (end - 1) % 3 + 2
        return self.start + start // 3 * 4 + start % 3, min(self.start + last, self.end)


class Replaced(Origin):
    """A copy of the layer above with some runs replaced: (new start, new end, old start, old end, step) of each, ascending;
    `step` is the size of the escape of each character, 0 if a character took several."""

    def __init__(self, runs: list[tuple[int, int, int, int, int]]):
        self.runs, self.starts = runs, [r[0] for r in runs]

    def _place(self, at: int, last: bool) -> int:
        """The old place of the character `at`: its first, or the one behind its last."""
        i = bisect.bisect_right(self.starts, at) - 1
        if i < 0:
            return at + last
        new, new_end, old, old_end, step = self.runs[i]
        if at >= new_end:
            return old_end + at - new_end + last
        if not step:
            return old_end if last else old
        return old + (at - new + last) * step

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self._place(start, False), self._place(end - 1, True)


class Layer:
    def __init__(self, text: str, above: Layer | None = None, origin: Origin | None = None, name: str = ""):
        self.text, self.above, self.origin = text, above, origin
        self.name = name if above is None or not above.name else f"{above.name}/{name}"

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The span of the original text."""
        layer = self
        while layer.above is not None:
            start, end = layer.origin.span(start, end)
            layer = layer.above
        return start, end

    def mark(self) -> tuple:
        """The same for layers of equal content from the same place."""
        return (*self.span(0, len(self.text)), hashlib.blake2b(self.text.encode("utf-8", "replace"), digest_size=16).digest())


class Endless(Exception):
    """Layers that keep growing."""


def _raw(run: str, kind: str) -> bytes:
    return bytes.fromhex(run.replace("%" if kind == "url" else "\\x", ""))


def _character(found: str) -> str | None:
    """The character of one Unicode escape; None if there is none."""
    if found[0] == "&":
        number = int(found[3:-1], 16) if found[2] in "xX" else int(found[2:-1])
    else:
        number = int(found[2:], 16)
    return chr(number) if 0 < number < 0x110000 else None


def unescaped(layer: Layer, kind: str) -> Layer | None:
    """The layer with its percent or Unicode escapes replaced; None without any. Bytes that are no UTF-8 stay as they are."""
    out, runs, at, size = [], [], 0, 0
    for m in (PERCENT if kind == "url" else UNICODE).finditer(layer.text):
        found = m.group()
        if found.startswith(("%", "\\x")):
            try:
                new = _raw(found, kind).decode()
            except UnicodeDecodeError:
                continue
        else:
            new = _character(found)
            if new is None:
                continue
        out += [layer.text[at : m.start()], new]
        size += m.start() - at
        step = 0 if not new.isascii() else 3 if found[0] == "%" else 4 if found[:2] == "\\x" else 0
        runs.append((size, size + len(new), m.start(), m.end(), step))
        size, at = size + len(new), m.end()
    if not runs:
        return None
    text = "".join([*out, layer.text[at:]])
    if any("\ud800" <= o <= "\udfff" for o in out if len(o) == 1):
        text, runs = _paired(text, runs)
    return Layer(text, layer, Replaced(runs), kind)


def _paired(text: str, runs: list[tuple[int, int, int, int, int]]) -> tuple[str, list[tuple[int, int, int, int, int]]]:
    """Two escapes that make one character beyond the basic plane become that character; single halves become U+FFFD."""
    shift, done, fixed = 0, [], []
    at = i = 0
    while i < len(runs):
        new, new_end, old, old_end, step = runs[i]
        fixed.append(text[at:new])
        piece = text[new:new_end]
        if len(piece) == 1 and "\ud800" <= piece <= "\udbff" and i + 1 < len(runs) and runs[i + 1][0] == new_end and "\udc00" <= text[new_end : runs[i + 1][1]] <= "\udfff":
            new_end, old_end, step = runs[i + 1][1], runs[i + 1][3], 0
            piece = text[new:new_end].encode("utf-16", "surrogatepass").decode("utf-16")
            i += 1
        elif len(piece) == 1 and "\ud800" <= piece <= "\udfff":
            piece = "�"
        fixed.append(piece)
        done.append((new - shift, new - shift + len(piece), old, old_end, step))
        shift += new_end - new - len(piece)
        at, i = new_end, i + 1
    return "".join([*fixed, text[at:]]), done


def decoded(run: str) -> bytes | None:
    """The bytes of a run of base64 characters, None if it is none."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def packed(data: bytes) -> bool:
    """Whether the bytes begin like compressed data."""
    return data.startswith(MAGIC) or (len(data) > 6 and data[0] & 0x8F == 0x08 and (data[0] * 256 + data[1]) % 31 == 0)


def unpacked(data: bytes, piece: int = PIECE) -> Iterator[bytes]:
    """The content of compressed data, `piece` bytes at a time; what follows an error or the end is left."""
    try:
        if data.startswith(MAGIC[3]):
            import io

            import zstandard

            with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(io.BytesIO(data), read_across_frames=True) as stream:
                while got := stream.read(piece):
                    yield got
            return
        if data.startswith(MAGIC[1]):
            work = bz2.BZ2Decompressor()
        elif data.startswith(MAGIC[2]):
            work = lzma.LZMADecompressor()
        else:
            work = zlib.decompressobj(31 if data.startswith(MAGIC[0]) else 15)
        rest = data
        while True:
            got = work.decompress(rest, piece)
            rest = work.unconsumed_tail if hasattr(work, "unconsumed_tail") else b""
            if got:
                yield got
            if work.eof or (not got and not rest):
                return
    except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard_error()):
        return


def zstandard_error() -> type[Exception]:
    import zstandard

    return zstandard.ZstdError


def readable(data: bytes) -> str | None:
    """The text of bytes that hold some; None otherwise."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if text.replace("\n", "").replace("\r", "").replace("\t", "").isprintable() and text else None


def _texts(parts: Iterator[bytes]) -> Iterator[str]:
    """Pieces of an unpacked text, cut where no find reaches across."""
    kept = b""
    for part in parts:
        kept += part
        cut = max(kept.rfind(c) for c in APART) if len(kept) >= PIECE else -1
        if cut >= 0:
            yield kept[: cut + 1].decode("utf-8", "replace")
            kept = kept[cut + 1 :]
    if kept:
        yield kept.decode("utf-8", "replace")


def layers_below(layer: Layer) -> Iterator[Layer]:
    """The layers that one layer wraps."""
    text = layer.text
    for kind, sign in (("url", "%"), ("unicode", "\\"), ("unicode", "&#")):
        if sign in text and not (sign == "&#" and "\\" in text):
            new = unescaped(layer, kind)
            if new is not None:
                yield new
    for m in BASE64.finditer(text):
        data = decoded(m.group())
        if data is None:
            continue
        if packed(data):
            yield from _unpack(layer, data, m.start(), m.end(), "base64/")
        found = readable(data)
        if found:
            yield Layer(found, layer, Quads(m.start(), m.end(), found), "base64")
    for kind, pattern, sign in (("url", PERCENT, "%"), ("unicode", BYTES, "\\x")):
        if sign in text:
            for m in pattern.finditer(text):
                data = _raw(m.group(), kind)
                if packed(data):
                    yield from _unpack(layer, data, m.start(), m.end(), f"{kind}/")


def _unpack(layer: Layer, data: bytes, start: int, end: int, way: str) -> Iterator[Layer]:
    """The text of compressed data, and of compressed data in it, as layers that stand for one run."""
    name, done, size = way + "packed", set(), 0
    while (mark := hashlib.blake2b(data, digest_size=16).digest()) not in done:
        done.add(mark)
        parts = unpacked(data)
        first = next(parts, b"")
        if not packed(first):
            for text in _texts(itertools.chain([first], parts)):
                yield Layer(text, layer, Whole(start, end), name)
            return
        data, name = b"".join([first, *parts]), name + "/packed"
        size += len(data)
        if size > GROWTH * (end - start) + PIECE:
            raise Endless


def finds(text: str | None) -> tuple[list[tuple[int, int, int, str, str]], int, bool]:
    """((kind, start, end, layers, secret) sorted by start, kind and end; number of layers; whether all were followed)."""
    if not text:
        return [], 0, True
    found: dict[tuple[int, int, int], tuple[str, str]] = {}
    # Each entry gives the layers below one that has been searched, when they are asked for.
    waiting: list[Iterator[Layer]] = [iter([Layer(text)])]
    done: set[tuple] = set()
    size = 0
    try:
        while waiting:
            layer = next(waiting[-1], None)
            if layer is None:
                waiting.pop()
                continue
            mark = layer.mark()
            if mark in done:
                continue
            done.add(mark)
            size += len(layer.text)
            if size > GROWTH * len(text) + PIECE:
                raise Endless
            for kind, start, end in search(layer.text):
                a, b = layer.span(start, end)
                found.setdefault((a, kind, b), (layer.name, layer.text[start:end]))
            waiting.append(layers_below(layer))
        whole = True
    except Endless:
        whole = False
    return [(k, a, b, *found[a, k, b]) for a, k, b in sorted(found)], len(done), whole


def scan(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, found (kind, start, end, layers, secret of each find; layers is empty for the text itself), n_layers, whole."""
    small_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    types = docs.sparkSession.createDataFrame([], f"key long, found array<{SPAN}>, n_layers long, whole boolean").schema
    spans = to_arrow_schema(types).field("found").type

    def run(batches):
        for batch in batches:
            results = [finds(t) for t in batch.column(1).to_pylist()]
            rows = [[dict(zip(("kind", "start", "end", "layers", "secret"), (KINDS[f[0]], *f[1:]), strict=True)) for f in r[0]] for r in results]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, spans), pa.array([r[1] for r in results], pa.int64()), pa.array([r[2] for r in results], pa.bool_())],
                ["key", "found", "n_layers", "whole"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(column).alias("text"))
    return rows.mapInArrow(run, types).withColumnRenamed("key", key)


def base(found: Column) -> Column:
    """The finds of the text itself."""
    return F.filter(found, lambda f: f["layers"] == "")


def listed(found: Column) -> Column:
    """kind:start:end of finds, comma-joined."""
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
