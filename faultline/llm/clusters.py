"""Centroid clustering of whole-number vectors through lossless dictionaries of subvectors.

Components are scaled and floored to whole numbers. Vectors are packed in chunks of at most `CHUNK` rows; in a chunk each
block of dimensions is replaced by codes into the block's dictionary of distinct subvectors. Blocks begin as
single dimensions; two neighbours become one block while their joint dictionary stays small against the chunk (`REUSE`
rows a subvector), so a table of copies ends as one code a vector and one of noise as one code a component. Nothing is
lost: a dictionary entry is the subvector itself.

In a round each chunk computes the squared distance of every dictionary entry from the centroids once; a vector's distance is
the sum over its codes. The sums that move the centroids come from counts of codes: how often a cluster uses an entry, times
the entry. A task returns one row per cluster, so a round shuffles no vectors and no cluster, however large, meets in one
task. All numbers are integers; results do not depend on partitioning.

Kept are vectors with exactly `size` components, none null, NaN or infinite. A component beyond 2^27 after scaling counts as not
finite, because squared distances would not fit a long. A null vector and other sizes are left out. Centroids start as the
k vectors of smallest hash of their id, ties by their components; vectors with a null id are clustered but start none. With
fewer than k such vectors there are fewer clusters; without any, no row. Equal distances go to the smaller number; an empty cluster keeps its
centroid. Repeated rows are clustered each on their own. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import small_batches, stage

SIZE, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Vectors in a chunk; rows per dictionary entry from which neighbouring blocks are joined.
CHUNK, REUSE = 16_384, 4
LARGEST = 1 << 27
PACKED = "ids binary, missing binary, blocks array<struct<width: int, entries: binary, codes: binary>>"


def whole_numbers(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """key (long), v (array<long>) of the vectors that are kept."""
    x = F.col("_x").cast("array<double>")
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & F.floor(c * scale).between(-LARGEST, LARGEST)
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(column).alias("_x")).where(F.size("_x") == size)
    return rows.where(F.forall(x, fine)).select("key", F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def encode(v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(entries, codes) of each block of dimensions, in order."""
    blocks = []
    for d in range(v.shape[1]):
        entries, codes = np.unique(v[:, d], return_inverse=True)
        blocks.append((entries[:, None], codes.reshape(-1)))
    while len(blocks) > 1:
        joined, change = [], False
        for i in range(0, len(blocks) - 1, 2):
            (e, c), (f, d) = blocks[i], blocks[i + 1]
            both, codes = np.unique(c * len(f) + d, return_inverse=True)
            if len(both) * REUSE <= len(v):
                joined.append((np.hstack([e[both // len(f)], f[both % len(f)]]), codes.reshape(-1)))
                change = True
            else:
                joined += [(e, c), (f, d)]
        if len(blocks) % 2:
            joined.append(blocks[-1])
        blocks = joined
        if not change:
            break
    return blocks


def _code_type(entries: int) -> type:
    return np.uint8 if entries <= 1 << 8 else np.uint16 if entries <= 1 << 16 else np.uint32


def pack(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """key, v as a staged table of chunks."""
    small_batches(rows.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(rows.sparkSession.createDataFrame([], PACKED).schema)

    def one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = pa.chunked_array([p.column(0) for p in parts])
        flat = np.concatenate([p.column(1).flatten().to_numpy(zero_copy_only=False) for p in parts]).astype(np.int64)
        blocks = [
            {"width": e.shape[1], "entries": e.astype(np.int64).tobytes(), "codes": c.astype(_code_type(len(e))).tobytes()}
            for e, c in encode(flat.reshape(len(ids), -1))]
        row = {
            "ids": ids.fill_null(0).to_numpy().astype(np.int64).tobytes(),
            "missing": np.packbits(ids.is_null().to_numpy()).tobytes(), "blocks": blocks}
        return pa.RecordBatch.from_pylist([row], schema=target)

    def run(batches):
        parts, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, chunk - n)
                batch = batch.slice(part.num_rows)
                parts.append(part)
                n += part.num_rows
                if n == chunk:
                    yield one(parts)
                    parts, n = [], 0
        if n:
            yield one(parts)

    return stage(rows.mapInArrow(run, PACKED), "chunks")


class Chunk:
    """The vectors of one packed row."""

    def __init__(self, row: dict):
        self.keys = np.frombuffer(row["ids"], np.int64)
        self.missing = np.unpackbits(np.frombuffer(row["missing"], np.uint8), count=len(self.keys)).astype(bool)
        self.blocks = []
        for b in row["blocks"]:
            entries = np.frombuffer(b["entries"], np.int64).reshape(-1, b["width"])
            self.blocks.append((entries, np.frombuffer(b["codes"], _code_type(len(entries)))))

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of each vector; one table of distances per block, then sums by code."""
        total, at = np.zeros((len(self.keys), len(centroids)), np.int64), 0
        for entries, codes in self.blocks:
            part = centroids[:, at : at + entries.shape[1]]
            table = np.stack([((entries - c) ** 2).sum(1) for c in part], 1)
            total += table[codes]
            at += entries.shape[1]
        cluster = total.argmin(1)
        return cluster, total[np.arange(len(total)), cluster]

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """Sum of each cluster's vectors, from how often it uses each entry."""
        out = []
        for entries, codes in self.blocks:
            used = np.bincount(cluster * len(entries) + codes, minlength=k * len(entries)).reshape(k, -1)
            out.append(used @ entries)
        return np.hstack(out)


def _chunks(batches) -> Iterator[Chunk]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Chunk(batch.slice(i, 1).to_pylist()[0])


def start(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k first vectors by the hash of their ids, in ascending order of the hashes."""
    first = rows.where("key is not null").select("v", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256).alias("h"))
    return np.array([r.v for r in first.orderBy("h", "v").limit(k).collect()], np.int64)


def moved(packed: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k = len(centroids)

    def work(batches):
        count, total = np.zeros(k, np.int64), np.zeros(centroids.shape, np.int64)
        for chunk in _chunks(batches):
            cluster, _ = chunk.nearest(centroids)
            count += np.bincount(cluster, minlength=k)
            total += chunk.sums(cluster, k)
        for c in np.flatnonzero(count):
            width = len(total[c])
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array(total[c]), pa.array([count[c]] * width, pa.int64())],
                ["cluster", "d", "total", "n"])

    parts = packed.mapInArrow(work, "cluster int, d int, total long, n long")
    out = centroids.copy()
    for r in parts.groupBy("cluster", "d").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r.cluster, r.d] = r.total // r.n
    return out


def assigned(packed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """key, cluster, distance of every vector."""

    def work(batches):
        for chunk in _chunks(batches):
            cluster, distance = chunk.nearest(centroids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunk.keys, mask=chunk.missing), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["key", "cluster", "distance"])

    return packed.mapInArrow(work, "key long, cluster int, distance long")


def cluster(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED,
            size: int = SIZE, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance of every kept vector; the final centroids)."""
    rows = whole_numbers(vectors, key, column, size, scale)
    centroids, packed = start(rows, k, seed), pack(rows)
    if not len(centroids):
        # Without an id no vector can start a cluster.
        return rows.where("false").selectExpr("key", "0 as cluster", "0L as distance"), centroids
    for _ in range(rounds):
        new = moved(packed, centroids)
        if (new == centroids).all():
            break
        centroids = new
    return assigned(packed, centroids), centroids


def with_inertia(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add cluster_inertia and inertia (distances summed over the cluster and over all; null beyond a long) and the final
    `centroid`; one row per cluster goes through the driver."""
    rows = stage(rows, "assigned")
    sums = {r.cluster: r.n for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    fit = lambda n: int(n) if n < 1 << 63 else None
    facts = [(c, fit(sums.get(c, 0)), fit(sum(sums.values())), v.tolist()) for c, v in enumerate(centroids)]
    known = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return rows.join(F.broadcast(known), "cluster")
