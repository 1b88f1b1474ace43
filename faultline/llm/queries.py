"""Registered queries of the corpus operators, and their checking SQL where SQL can say the same."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.common import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
END_ID = 2
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def query(run):
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op2_tree_bpe(spark, sf_dir):
    """Whole texts to ids and back."""
    from faultline.llm import treebpe

    encoded = treebpe.encode(table(spark, sf_dir, "documents"), byte_bpe_path())
    return treebpe.decoded_digests(encoded, byte_bpe_path())


@query
def op3_splitter_shards(spark, sf_dir):
    """All documents in eight shards of near equal bytes."""
    from faultline.llm import shards

    return shards.shard(table(spark, sf_dir, "documents"), n=8)


@query
def op4_token_files(spark, sf_dir):
    """Ids of all documents to files and back."""
    from faultline.llm import tokenfiles

    folder = scratch(spark, "tokens")
    files = tokenfiles.write(table(spark, sf_dir, "documents"), byte_bpe_path(), folder, END_ID)
    return tokenfiles.read(spark, files, folder)


@query
def op10_kernel_language(spark, sf_dir):
    """Language of every document."""
    from faultline.llm import langid

    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op1_ordinal_quality(spark, sf_dir):
    """Expected grade and tail probability of every document, and whether it is kept."""
    from faultline.llm import quality

    return quality.grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_arc_converter(spark, sf_dir):
    """All pages through ARC and WARC files."""
    from faultline.llm import arc

    return arc.round_trip(table(spark, sf_dir, "pages"), scratch(spark, "archives"))


ORACLES["op5_arc_converter"] = """
select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as payload_digest,
  case when strlen(html) >= 1000 and page_id <> newest then 'revisit' else 'response' end as record_type,
  case when strlen(html) >= 1000 and page_id <> newest then newest end as refers_to
from (select *, max(page_id) over (partition by coalesce(html, '')) as newest from pages)
"""


@query
def op7_circulant_minhash(spark, sf_dir):
    """Groups of documents that share at least 80 % of their four-word shingles."""
    from faultline.llm import neardup

    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


# All pairs that share a shingle; only for small tables.
ORACLES["op7_circulant_minhash"] = rf"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^ \t\n\v\f\r]+') as w from documents
), sets as (
  select doc_id, list_distinct(case when len(w) >= 4 then [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from worded
), shingles as (select doc_id, len(s) as n, unnest(s) as x from sets),
links as (
  select a.doc_id as a, b.doc_id as b from shingles a join shingles b on a.x = b.x and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach as (
  select doc_id, doc_id as other from documents
  union
  select r.doc_id, l.b from reach r join links l on l.a = r.other
), found as (select doc_id, min(other) as component_id from reach group by 1)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, f.component_id, s.doc_id = f.component_id as kept
from sets s join found f on f.doc_id = s.doc_id
"""


@query
def op9_simhash_decontamination(spark, sf_dir):
    """Benchmark passages found in the documents."""
    from faultline.llm import decontam

    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_bottom_k(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    from faultline.llm import sketches

    return sketches.compare_with_edits(table(spark, sf_dir, "documents"))


@query
def op6_diagonal_licences(spark, sf_dir):
    """License phrases and texts in every document."""
    from faultline.llm import licences

    return licences.scan(table(spark, sf_dir, "documents"))


@query
def op11_aho_resample(spark, sf_dir):
    """Documents drawn towards the benchmark's word runs."""
    from faultline.llm import resample

    rows = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20)
    return rows.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


@query
def op12_subvector_clusters(spark, sf_dir):
    """Eight clusters of all vectors after ten rounds."""
    from faultline.llm import clusters

    rows, centroids = clusters.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3)
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    return clusters.with_inertia(rows, centroids).select(
        F.col("key").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _cluster_sql(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """Each round as two tables: vectors with their nearest centroid, centroids after the move."""
    parts = [f"""
kept as materialized (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
), c0 as materialized (
  select cast(row_number() over (order by sha256('{seed}:' || vec_id), v) - 1 as int) as c, v from kept
  where vec_id is not null order by c limit {k}
)"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} as materialized (
  select vec_id, v, near.c as cluster, near.d as distance from (
    select vec_id, v, (select min(struct_pack(
        d := cast(list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint), c := c{i}.c)) from c{i}) as near
    from kept))""")
        if i < rounds:
            parts.append(f"""c{i + 1} as materialized (
  select c{i}.c, coalesce(n.v, c{i}.v) as v from c{i} left join (
    select cluster, list(m order by d) as v from (
      select cluster, d, cast(floor(sum(x) / count(*)) as bigint) as m
      from (select cluster, unnest(v) as x, generate_subscripts(v, 1) as d from a{i}) group by cluster, d) group by cluster) n on n.cluster = c{i}.c)""")
    return "with" + ", ".join(parts) + f"""
select vec_id, cluster, distance, cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia,
  cast(sum(distance) over () as bigint) as inertia, sha256(array_to_string(c{rounds}.v, ',')) as centroid_sha256
from a{rounds} join c{rounds} on c{rounds}.c = cluster
"""


ORACLES["op12_subvector_clusters"] = _cluster_sql()


@query
def op13_recursive_secrets(spark, sf_dir):
    """Secrets in all documents and in what they wrap."""
    from faultline.llm import nested

    rows = nested.scan(table(spark, sf_dir, "documents"))
    base = nested.base(F.col("found"))
    count = lambda kind: F.size(F.filter(base, lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id", *[count(kind) for kind in nested.KINDS], F.sha2(nested.listed(base), 256).alias("base_sha256"),
        nested.listed(F.col("found")).alias("spans"), "n_layers")
