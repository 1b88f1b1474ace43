"""Whole license texts, exact, edited, in part and against brute force."""

import random
import re

from faultline.llm import licences
from faultline.llm.licence_texts import TEXTS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower().decode())


def covered(template, text, k):
    """Largest share of a template's words in runs of k that stand in order on neighbouring diagonals of a text."""
    t, w = words(template), words(text)
    places = {}
    for i in range(len(w) - k + 1):
        places.setdefault(tuple(w[i : i + k]), []).append(i)
    diagonals = {}
    for at in range(len(t) - k + 1):
        for pos in places.get(tuple(t[at : at + k]), []):
            diagonals.setdefault(pos - at, set()).add(at)
    kept = sorted(d for d, ats in diagonals.items() if len(ats) >= licences.VOTES)
    best, group, last = 0.0, set(), None
    for d in kept:
        if last is not None and d - last > licences.GAP:
            group = set()
        group, last = group | diagonals[d], d
        best = max(best, len({x for at in group for x in range(at, at + k)}) / len(t))
    return best


def test_whole_texts(make_docs):
    rng = random.Random(9)
    filler = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "of", "the", "in"]) for _ in range(n))
    given, want = [], {}
    for i, (name, text) in enumerate(TEXTS.items()):
        edited = text.split()
        for _ in range(len(edited) // 40):
            edited[rng.randrange(len(edited))] = "changed"
        half = " ".join(text.split()[: len(text.split()) // 2])
        for j, part in enumerate((text, " ".join(edited), half)):
            given.append((3 * i + j, f"Copyright 2020 somebody {filler(30)} {part} {filler(30)}"))
            want[3 * i + j] = name if j < 2 else None
    rows = {r.doc_id: r for r in licences.scan(make_docs(given), base={"x y": "none"}, templates={"y z": "none"}).collect()}
    for doc, text in given:
        labels = set(filter(None, rows[doc].labels.split(",")))
        shares = {name: covered(template, text, licences.K_TEXT) for name, template in TEXTS.items()}
        assert labels <= {name for name, share in shares.items() if share >= licences.LEAST}
        if want[doc]:
            assert want[doc] in labels and shares[want[doc]] == max(shares.values()), (doc, labels, shares)
            assert abs(rows[doc].score - max(shares.values())) < 1e-9
        elif max(shares.values()) < licences.LEAST:
            assert labels == set() and rows[doc].score == 0
