"""Near duplicates with circulant MinHash.

A document is the set of its distinct word shingles. One permutation places shingles on a circle of `CIRCLE` places, a
second numbers the places; coordinate k of the signature is the smallest number found when the second permutation is
turned by k places. `BANDS` groups of `ROWS` coordinates are bucket keys: two documents of similarity 0.8 share none of
them with a chance of 5e-8.

Documents with equal sets are one class; only its smallest doc_id goes on, so copies cost one row each. The class whose
buckets are largest in sum is the centre of a bucket: in a family of edited copies that is the text they were made of.
Every class is first compared with one centre, the largest of its buckets; verified links make components. Then classes
are compared with the centres of all their buckets that are in other components, and at last the classes that share a
bucket and are still in different components with each other, block by block: signatures that agree in fewer than
`LEAST_AGREEMENT` of the coordinates have similarity 0.8 with a chance under 1e-7, all other pairs are verified on full
sets, each in one bucket only, and a block gives at most one link per class. Pairs within a component need no comparison,
so the components are those of all links, and no step makes more rows than a class has buckets.

A null or empty text, or one without words, has an empty set and is linked with nothing. A row with a null doc_id is
linked with nothing; its component is null and it is kept. Rows that share a doc_id are one document. Other columns
are left out.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import map_columns, small_batches, stage, tidy, without
from faultline.llm.components import components
from faultline.llm.words import BLANKS, hashed_words, mix, shingle_set

CIRCLE, BANDS, ROWS = 1 << 20, 32, 4
LEAST_AGREEMENT = 0.6
#: Classes of a bucket in one block of signature comparisons.
BLOCK = 1024
#: Ids sent to all tasks at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


@lru_cache(maxsize=1)
def _turned() -> np.ndarray:
    """Row p: the numbers of the places from p on, one for each turn."""
    numbers = np.random.Generator(np.random.PCG64(7)).permutation(CIRCLE).astype(np.int32)
    k = BANDS * ROWS
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([numbers, numbers[: k - 1]]), k)


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates of a set that is not empty."""
    turned = _turned()
    at = np.unique(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(CIRCLE - 1)).astype(np.int64)
    low = turned[at[:4096]].min(0)
    for i in range(4096, len(at), 4096):
        low = np.minimum(low, turned[at[i : i + 4096]].min(0))
    return low


def band_keys(sig: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for column in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
    return h.view(np.int64)


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (the set's hash, null if empty), bands, keys (bands as bytes), sig (a byte of each
    coordinate)."""

    def work(cols):
        out = {n: [] for n in ("n_shingles", "k1", "k2", "bands", "keys", "sig")}
        for text in cols.pop("text"):
            found = shingle_set(hashed_words(text, BLANKS)[0], k)
            key = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64).tolist() if len(found) else (None, None)
            sig = signature(found) if len(found) else None
            bands = band_keys(sig) if len(found) else None
            for name, value in zip(out, (len(found), *key, bands, None if bands is None else bands.tobytes(), None if sig is None else mix(sig.astype(np.uint64)).astype(np.uint8).tobytes()), strict=True):
                out[name].append(value)
        return cols | out

    schema = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, keys binary, sig binary"
    return map_columns(docs.select(F.col("doc_id").cast("long"), "text"), work, schema)


def sets_of(ids: DataFrame, n: int, docs: DataFrame, k: int) -> DataFrame:
    """node, found (the set's hashes) of the given nodes; up to BROADCAST_IDS of them find their texts without a shuffle.

    Rows that share a doc_id are one document; the set of any of them is taken."""
    wanted = F.broadcast(ids) if n <= BROADCAST_IDS else ids
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(wanted, "node", "left_semi")

    def sets(cols):
        return {"node": cols["node"], "found": [shingle_set(hashed_words(t, BLANKS)[0], k).tobytes() for t in cols["text"]]}

    return stage(map_columns(texts, sets, "node long, found binary"), "pair-sets")


def linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share at least percent / 100 of their union."""
    small, large = (p, q) if len(p) < len(q) else (q, p)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(p) + len(q) - both)


def verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have similarity of at least percent / 100."""
    pairs = stage(pairs.select("a", "b").distinct(), "pairs")
    n = pairs.count()
    if not n:
        return pairs
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = sets_of(ids, 2 * n, docs, k)
    left = found.select(F.col("node").alias("a"), F.col("found").alias("x"))
    right = found.select(F.col("node").alias("b"), F.col("found").alias("y"))

    def check(cols):
        ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(cols["x"], cols["y"], strict=True)]
        return {"a": cols["a"], "b": cols["b"], "ok": ok}

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return map_columns(joined, check, "a long, b long, ok boolean").where("ok").select("a", "b").distinct()


def agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose signatures agree in at least LEAST_AGREEMENT of the coordinates."""

    def work(cols):
        if not cols["a"]:
            return {"a": [], "b": []}
        x = np.frombuffer(b"".join(cols["x"]), np.uint8).reshape(len(cols["x"]), -1)
        y = np.frombuffer(b"".join(cols["y"]), np.uint8).reshape(len(cols["y"]), -1)
        good = (x == y).mean(1) >= LEAST_AGREEMENT
        return {n: np.array(cols[n], np.int64)[good] for n in ("a", "b")}

    x = nodes.select(F.col("node").alias("a"), F.col("sig").alias("x"))
    y = nodes.select(F.col("node").alias("b"), F.col("sig").alias("y"))
    return map_columns(pairs.distinct().join(x, "a").join(y, "b").select("a", "b", "x", "y"), work, "a long, b long")


def blocked(members: DataFrame) -> DataFrame:
    """Members of buckets, dealt to pairs of blocks: a bucket of n members has ceil(n / BLOCK) blocks, and each pair of
    blocks is one group of at most about 2 * BLOCK rows."""
    rows = members.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.hash("node"), "blocks"))
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "sig", "bands")


def _groups(batches):
    """Tables of the rows of one (bucket, i, j) each, from sorted batches."""
    import pyarrow as pa

    kept = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        kept = table if kept is None else pa.concat_tables([kept, table])
        key = np.stack([kept[c].to_numpy() for c in ("bucket", "i", "j")], 1)
        edges = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        for start, end in zip([0, *edges[:-1]], edges, strict=False):
            yield kept.slice(start, end - start)
        if len(edges):
            kept = kept.slice(edges[-1])
    if kept is not None and kept.num_rows:
        yield kept


def _candidates(group):
    """(row, other rows) of a group to compare: in different components, signatures that agree, and no earlier band
    that both have, so each pair is seen in one bucket."""
    own, node, component = (group[c].to_numpy() for c in ("own", "node", "component"))
    if len(node) < 2 or (component == component[0]).all():
        return
    sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint8).reshape(len(node), -1)
    bands = np.frombuffer(b"".join(group["bands"].to_pylist()), np.int64).reshape(len(node), -1)
    bucket, i, j = (group[c][0].as_py() for c in ("bucket", "i", "j"))
    band = int(np.argmax(bands[0] == bucket))
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    for r in left:
        others = right[node[right] > node[r]] if i == j else right
        others = others[component[others] != component[r]]
        if len(others):
            others = others[(sig[others] == sig[r]).mean(1) >= LEAST_AGREEMENT]
            others = others[~(bands[others, :band] == bands[r, :band]).any(1)]
            if len(others):
                yield r, others


def across(members: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified links between members of one bucket in different components.

    members: bucket, size, node, component, sig, bands (the class's band keys as bytes). Signatures tell first which
    members of a group have a pair to verify; only for these are sets fetched. Neither step gives rows for pairs: the
    first names members, the second links classes that the group has not joined yet."""
    order, key = ["bucket", "i", "j"], "bucket long, i int, j int, own int, node long, component long, sig binary, bands binary"

    def involved(batches):
        for group in _groups(batches):
            rows = {int(x) for r, others in _candidates(group) for x in (r, *others)}
            if rows:
                yield from group.take(sorted(rows)).combine_chunks().to_batches()

    def join(batches):
        import pyarrow as pa

        for group in _groups(batches):
            node, column = group["node"].to_numpy(), group["found"].combine_chunks()
            # Sets are read where they lie in the batches.
            sets = lambda i, column=column: np.frombuffer(column[i].as_buffer(), np.uint64)
            root = {c: c for c in group["component"].to_pylist()}

            def top(c, root=root):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            component, out = group["component"].to_pylist(), []
            for r, others in _candidates(group):
                p = sets(r)
                for x in others.tolist():
                    a, b = top(component[r]), top(component[x])
                    if a != b and linked(p, sets(x), percent):
                        root[a] = b
                        out.append((min(node[r], node[x]), max(node[r], node[x])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], pa.int64()) for n in (0, 1)], names=["a", "b"])

    sorted_rows = blocked(members).repartition(*order).sortWithinPartitions(*order)
    named = stage(sorted_rows.mapInArrow(tidy(involved), key), "involved")
    n = named.count()
    if not n:
        return named.select(F.col("node").alias("a"), F.col("node").alias("b"))
    found = sets_of(named.select("node").distinct(), n, docs, k)
    full = named.join(found.dropDuplicates(["node"]), "node").select(*order, "own", "node", "component", "sig", "bands", "found")
    return full.repartition(*order).sortWithinPartitions(*order).mapInArrow(tidy(join), "a long, b long").distinct()


def _star(rows: DataFrame) -> DataFrame:
    """Pairs of a class and a centre."""
    return rows.where("node <> centre.node").select(
        F.least("node", "centre.node").alias("a"), F.greatest("node", "centre.node").alias("b"))


def _labels(links: DataFrame) -> DataFrame:
    return stage(components(links), "components")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    left = labels.select(F.col("node").alias("a"), F.col("component").alias("x"))
    right = labels.select(F.col("node").alias("b"), F.col("component").alias("y"))
    both = pairs.join(left, "a", "left").join(right, "b", "left")
    return both.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    small_batches(docs.sparkSession)
    rows = stage(sketch(docs, k), "sketches")
    able = rows.where("doc_id is not null and k1 is not null")
    best = able.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"))
    classes = stage(best, "classes")
    nodes = able.join(classes, ["k1", "k2"]).where("doc_id = node").select("node", "bands", "keys", "sig").dropDuplicates(["node"])
    nodes = stage(nodes, "nodes")
    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = stage(placed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = stage(placed.join(sizes, "bucket"), "members")
    weights = members.groupBy("node").agg(F.sum("size").alias("weight"))
    weighted = stage(members.join(weights, "node"), "weighted")
    centres = weighted.groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("centre"))
    starred = stage(members.join(stage(centres, "centres"), "bucket"), "starred")
    one = starred.groupBy("node").agg(F.max("centre").alias("centre"))
    links = stage(verify(agreeing(_star(one), nodes), docs, k, percent), "links")
    found = _labels(links)
    stars = _star(starred).distinct()
    links = links.union(stage(verify(agreeing(_apart(stars, found), nodes), docs, k, percent), "links"))
    found = _labels(links)
    # A bucket of two has been compared in full.
    left = members.where("size > 2").join(found, "node", "left").select(
        "bucket", "size", "node", F.coalesce("component", "node").alias("component"))
    left = stage(left, "left")
    mixed = left.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    rest = left.join(stage(mixed, "mixed"), "bucket").join(nodes.select("node", "sig", F.col("keys").alias("bands")), "node")
    more = stage(across(rest, docs, k, percent), "links")
    if not more.isEmpty():
        found = _labels(links.union(more))
    with_class = rows.join(classes, ["k1", "k2"], "left")
    joined = with_class.join(found, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows, whole, of the document with the smallest doc_id of each group; null doc_ids stay."""
    return without(docs, "doc_id", near_duplicates(docs, k, percent).where("not kept"))
