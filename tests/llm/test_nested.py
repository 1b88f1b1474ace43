"""Secrets in texts and in what they wrap."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import zlib
from urllib.parse import quote

import pytest
import zstandard

from faultline.llm import nested
from faultline.llm.queries import op13_recursive_secrets

KEY = "AKIA" + "Q7WE2RT9YU4IOP5A"
LINE = f"api_key = {KEY}, then more words"


def b64(data):
    return base64.b64encode(data.encode() if isinstance(data, str) else data).decode()


def escaped(text):
    return "".join(f"\\u{ord(c):04x}" for c in text)


def at_every_place(text, pattern, good):
    """Leftmost matches, one place after the other."""
    at, out = 0, []
    while at < len(text):
        m = pattern.match(text, at)
        if m:
            if good(m):
                out.append((m.start(), m.end()))
            at = m.end()
        else:
            at += 1
    return out


def base(text):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    rules = [(assign, lambda m: len(m[2]) >= 8), (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)]
    found = sorted((a, k, b) for k, (pattern, good) in enumerate(rules) for a, b in at_every_place(text, pattern, good))
    return [f"{nested.KINDS[k]}:{a}:{b}" for a, k, b in found]


def spans(text):
    found, _, whole = nested.finds(text)
    assert whole
    return {(nested.KINDS[k], a, b) for k, a, b, _, _ in found}


@pytest.fixture(scope="module")
def given(odd_texts):
    rng = random.Random(6)
    parts = ["token", "api_key", "APIKEY", "password", "ſecret", "toKen", ":", "=", " ", "  ", "'", '"', "AKIA", "ABCD1234EFGH", "deadbeef" * 4, "abc", "xy.z/+=-_1", "é", "%3D", "\\u003d", "&#61;", "%", "\n"]
    return odd_texts + [(500 + i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 60)))) for i in range(200)]


def test_base_against_every_place(spark, make_docs, given, tmp_path):
    make_docs(given).write.parquet(f"{tmp_path}/documents.parquet")
    rows = op13_recursive_secrets(spark, str(tmp_path)).collect()
    want = sorted((str(d), ",".join(base(t))) for d, t in given)
    assert len(rows) == len(given)
    assert sorted((str(r.doc_id), r.base_sha256) for r in rows) == [(d, h) for d, h in sorted((d, hashlib.sha256(s.encode()).hexdigest()) for d, s in want)]
    texts = {d: base(t) for d, t in given if d is not None}
    for r in rows:
        if r.doc_id is not None:
            found = r.spans.split(",") if r.spans else []
            assert set(texts[r.doc_id]) <= set(found) and len(set(found)) == len(found)
            assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in texts[r.doc_id]) for k in nested.KINDS]
            keys = [(int(s.split(":")[1]), nested.KINDS.index(s.split(":")[0]), int(s.split(":")[2])) for s in found]
            assert keys == sorted(keys)


PACKERS = {"gzip": gzip.compress, "zlib": zlib.compress, "bz2": bz2.compress, "xz": lzma.compress, "zstd": zstandard.ZstdCompressor().compress}


@pytest.mark.parametrize("pack", PACKERS)
def test_compressed_layers_stand_for_their_run(pack):
    run = b64(PACKERS[pack](LINE.encode()))
    text = f"before {run} after"
    assert spans(text) >= {("access", 7, 7 + len(run)), ("assign", 7, 7 + len(run))}
    twice = b64(PACKERS[pack](gzip.compress(b64(PACKERS[pack](LINE.encode())).encode())))
    assert ("access", 3, 3 + len(twice)) in spans(f"é: {twice}")


def test_spans_of_escapes():
    for wrap in (lambda s: quote(s, safe=""), escaped, lambda s: "".join(f"%{b:02x}" for b in s.encode()), lambda s: "".join(f"&#{ord(c)};" for c in s),
                 lambda s: "".join(f"&#x{ord(c):x};" for c in s), lambda s: "".join(f"\\x{b:02x}" for b in s.encode()), lambda s: "".join(f"\\U{ord(c):08X}" for c in s)):
        before = "naïve 日本 "
        text = before + wrap(f'secret="{KEY}"') + " é"
        start, end = len(before + wrap('secret="')), len(before + wrap(f'secret="{KEY}'))
        assert ("access", start, end) in spans(text), text
        assert ("assign", len(before), end) in spans(text)


def test_spans_of_base64():
    for lead in ("", "x", "xy", "xyz", "é", "日本 "):
        run = b64(f"{lead}{KEY} tail")
        start, end = len(lead.encode()), len((lead + KEY).encode())
        found = [s for s in spans(f"__ {run}") if s[0] == "access"]
        want = (3 + start // 3 * 4 + start % 3, 3 + (end - 1) // 3 * 4 + (end - 1) % 3 + 2)
        assert found == [("access", *want)]
        # The characters of the span hold all bits of the find, and no smaller span does.
        assert want[0] * 6 <= (start + 4) * 8 and KEY[1:-1] in base64.b64decode(run).decode()


def test_context_around_an_escape_is_kept():
    assert spans("password%3Dcorrecthorse") == {("assign", 0, 23)}
    assert spans("token\\u003aabcdefgh12") == {("assign", 0, 21)}


def test_deep_nests_in_any_order():
    rng, wraps = random.Random(11), [b64, escaped, lambda s: quote(s, safe=""), lambda s: b64(gzip.compress(s.encode(), mtime=0)), lambda s: b64(zlib.compress(s.encode()))]
    for _ in range(40):
        text = LINE
        for _ in range(rng.randrange(1, 6)):
            text = rng.choice(wraps)(text)
            if len(text) > 200_000:
                break
        found, layers, whole = nested.finds(f"see: {text} .")
        inner = [f for f in found if f[0] == 1]
        assert whole and inner and all(5 <= f[1] < f[2] <= 5 + len(text) for f in inner) and any(f[4] == KEY for f in inner)


def test_many_orders_of_undoing_end_soon():
    text = LINE.replace(" ", "%2525252525252520").replace("=", "\\u005cu005cu005cu003d")
    _, layers, whole = nested.finds(text)
    assert whole and layers < 60


def test_cycles_end(monkeypatch):
    data = b"\x1f\x8bself"
    monkeypatch.setattr(nested, "unpacked", lambda d, piece=0: iter([data]))
    assert nested.finds(f"a {b64(data + b'0123456789')} b")[0] == []
    grow = [b"\x1f\x8b"]

    def larger(d, piece=0):
        grow[0] += b"x" * (1 << 20)
        return iter([grow[0]])

    monkeypatch.setattr(nested, "unpacked", larger)
    assert nested.finds(f"a {b64(data + b'0123456789')} b")[2] is False


def test_large_content_of_a_small_run():
    content = b"".join(b"line %d of a file\n" % i for i in range(400_000)) + LINE.encode()
    run = b64(gzip.compress(content))
    found, layers, whole = nested.finds(f"x {run}")
    assert whole and layers > 2 and (1, 2, 2 + len(run)) in {f[:3] for f in found}


def test_broken_and_ordinary_data():
    good = b64(gzip.compress(LINE.encode()))
    for text in (good[:30], good[:-8] + "AAAAAAAA", "internationalization" * 3, "%ZZ%4", "%ff%fe%41", "\\ud800 \\udc00\\ud83d\\ude00", "&#0;&#1114112;&#xD800;", "=" * 40, "A" * 17):
        assert nested.finds(text)[2]
    assert nested.finds(None) == ([], 0, True) and nested.finds("") == ([], 0, True)


def test_columns_and_empty_table(spark, make_docs):
    assert nested.scan(make_docs([])).count() == 0
    row = nested.scan(make_docs([(3, LINE)])).first()
    assert [(f.kind, f.start, f.end, f.layers, f.secret) for f in row.found] == [("assign", 0, 30, "", LINE[:30]), ("access", 10, 30, "", KEY)]
