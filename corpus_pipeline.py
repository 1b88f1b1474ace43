"""The corpus pipeline: documents through five stages, each written as Parquet and read by the next.

Documents of unknown language, documents of low grade and documents with a benchmark passage go; of each group of near
duplicates one stays; the rest is encoded. All but the last stage return the columns of `documents`, rows whole.

A null or empty text, or one without letters, has no known language and goes with the first stage; so later stages see texts with
words, however long. Rows with a null doc_id pass every stage and are never near duplicates. Rows that share a doc_id are judged each on
their own but by near duplicates, where they are one document: they stay or go together. Copies tie for nothing: of a group the
smallest doc_id stays. Without ratings the quality stage keeps all, without benchmark items decontamination does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.llm import decontam, langid, neardup, quality, treebpe
from faultline.llm.common import stage
from faultline.llm.queries import byte_bpe_path, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the string kernels know; `und` and uncertain ones go."""
    return langid.known(docs)


def grades(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are good and not toxic by their grade."""
    return quality.good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles."""
    return neardup.one_of_each(docs, k=5, percent=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    path = byte_bpe_path()
    return treebpe.decoded_digests(treebpe.encode(docs, path), path)


STAGES = [
    ("language", language),
    ("quality", grades),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_passages),
    ("tokens", tokens),
]
# The fitted models and MinHash are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
