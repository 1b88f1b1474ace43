"""BPE encoding by joined halves, and token files, against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from faultline.llm import tokenfiles, treebpe
from faultline.llm.bytebpe import byte_bpe
from faultline.session import scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_joined_halves_equal_the_library(library):
    rng, bpe = random.Random(1), byte_bpe(PATH)
    alphabet = ["a", "b", "e", "th", "'", "'s", "'re", "l", " ", "  ", "\n", "1", "é", "😀", "中", "!", "\x1c", "²", "<|endoftext|>", "the", "́", "\x85"]
    for _ in range(600):
        letters = rng.sample(alphabet, rng.choice([2, 6, len(alphabet)]))
        text = "".join(rng.choice(letters) for _ in range(rng.choice([5, 40, 300, 1200])))
        want, found = ids_of(library, text), []
        assert np.frombuffer(bpe.encode(text), np.uint32).tolist() == want
        for i, part in enumerate(bpe.segments(text)):
            if i % 2:
                found.append(bpe.special[part])
            else:
                nodes = [(p, np.frombuffer(bpe.plain(p), np.uint32)) for p in treebpe.halves(part, rng.choice([4, 16, 100]))]
                found += treebpe.join_all(bpe, nodes).tolist()
        assert found == want, text


def test_encode_and_decode(spark, make_docs, odd_texts, library):
    encoded = treebpe.encode(make_docs(odd_texts), PATH, leaf=64)
    rows = treebpe.digests(treebpe.decode(encoded, PATH)).collect()
    want = []
    for doc, text in odd_texts:
        ids = ids_of(library, text)
        back = library.decode(ids, skip_special_tokens=False)
        want.append((doc or -1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(want)


def test_token_files(spark, make_docs, odd_texts, library):
    folder = scratch(spark, "tokens")
    files = tokenfiles.write(make_docs(odd_texts), PATH, folder, 2, rows_per_file=8)
    assert files.count() > 3
    got = {(r.doc_id or -1, r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.read(spark, files, folder).collect()}
    start, want = 0, set()
    for doc, text in sorted(odd_texts, key=lambda r: r[0] or -1):
        ids = np.array([*ids_of(library, text), 2], "<u4")
        want.add((doc or -1, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    one = next(r for r in files.collect() if r.start == 0)
    found = tokenfiles.TokenFile(folder, one.file)
    assert found.document(5).tolist() == [*ids_of(library, "one two three"), 2]


def test_empty_tables(spark, make_docs):
    docs, folder = make_docs([]), scratch(spark, "tokens")
    assert treebpe.digests(treebpe.decode(treebpe.encode(docs, PATH), PATH)).count() == 0
    assert tokenfiles.read(spark, tokenfiles.write(docs, PATH, folder, 2), folder).count() == 0
