"""The pipeline's stages, each judged on its own input."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_text_search import best_share, expected

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, found = corpus_pipeline.table(spark, FOLDER, "documents"), []
    for name, apply in corpus_pipeline.STAGES:
        out = corpus_pipeline.stage(apply(spark, docs, FOLDER), name)
        found.append((docs, out))
        docs = out
    return found


def test_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "decontamination", "tokens"]
    for before, after in steps[:-1]:
        assert after.columns == before.columns and after.exceptAll(before).count() == 0


def test_clean_documents_stay(spark, steps):
    assert steps[0][1].count() == steps[0][0].where("text rlike '[[:alpha:]\\\\p{L}]'").count()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    before, after = steps[1]
    share = lambda rule: after.join(labels.where(rule), "doc_id").count() / max(1, before.join(labels.where(rule), "doc_id").count())
    assert share("quality = 1 and toxic = 0") > 0.95 and share("quality = 0 or toxic = 1") < 0.2


def test_one_of_each_group_stays(steps):
    before, after = steps[2]
    want = {d for d, (_, c) in expected([(r.doc_id, r.text) for r in before.collect()], 5).items() if c == d}
    assert {r.doc_id for r in after.collect()} == want


def test_passages_go(spark, steps):
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    before, after = steps[3]
    left = {r.doc_id for r in after.collect()}
    for r in before.collect():
        if len(r.text) < 6000:
            assert (r.doc_id in left) == all(best_share(i, r.text) < 0.8 for i in items), r.doc_id


def test_tokens(steps):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before, after = steps[4]
    want = {}
    for r in before.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after.collect()} == want
