"""Shards of near equal bytes from sampled splitters.

Records are ordered by (hash of the text, doc_id), so equal texts stand together. Keys are drawn with a chance in
proportion to their size; quantiles of the draw are the boundaries of ranges, and ranges that turn out overfull are
drawn from again and divided. Exact sizes of the ranges and running sums inside each then give every record its place
in the whole, and the places where shards begin are looked up exactly. A group of equal texts across such a place goes
to the side with the nearer end, unless it holds more than `slack` of a shard; then it is divided.

Only small keys travel, never texts. A null text has no bytes and counts 1, as an empty one, and is grouped with it.
Null doc_ids come first within a group; repeated rows each take a place. Other columns are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import map_columns, stage

ROWS_PER_RANGE, MOST_RANGES, DRAWN_PER_RANGE = 16_384, 16_384, 32
#: A range is overfull with more than so many times the rows meant for it.
OVERFULL = 4
LAW = "bytes"


def splitters(drawn: np.ndarray, n: int) -> np.ndarray:
    """n - 1 boundary keys at equal steps of the drawn weight; columns h, d, weight."""
    drawn = drawn[np.lexsort((drawn["d"], drawn["h"]))]
    if not len(drawn) or n < 2:
        return drawn[:0]
    at = np.cumsum(drawn["w"])
    found = np.searchsorted(at, at[-1] * np.arange(1, n) / n)
    return drawn[np.unique(np.minimum(found, len(drawn) - 1))]


def place(cuts: np.ndarray, h: np.ndarray, d: np.ndarray) -> np.ndarray:
    """How many cuts are at or below each key (h, d)."""
    low, high = np.searchsorted(cuts["h"], h, "left"), np.searchsorted(cuts["h"], h, "right")
    out = low.copy()
    for value in np.unique(h[high > low]):
        mine = h == value
        a, b = np.searchsorted(cuts["h"], value, "left"), np.searchsorted(cuts["h"], value, "right")
        out[mine] = a + np.searchsorted(cuts["d"][a:b], d[mine], "right")
    return out


KEY = np.dtype([("h", "i8"), ("d", "i8"), ("w", "f8")])


def _ranged(keys: DataFrame, cuts: np.ndarray) -> DataFrame:
    def work(cols):
        h, d = np.array(cols["h"], "i8"), np.array(cols["d"], "i8")
        return cols | {"range": place(cuts, h, d)}

    names = "doc_id long, size long, text_crc32 long, h long, d long"
    return map_columns(keys, work, names + ", range int")


def _draw(keys: DataFrame, n: int, total: int, seed: int) -> np.ndarray:
    """About `DRAWN_PER_RANGE * n` keys, larger records more often; a record over the step is always drawn."""
    step = max(1.0, total / (DRAWN_PER_RANGE * n))
    u = F.pmod(F.xxhash64("h", "d", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    rows = keys.where(u * step < F.col("size")).select("h", "d", F.greatest(F.col("size"), F.lit(step)).alias("w"))
    return np.array([(r["h"], r["d"], r["w"]) for r in rows.collect()], KEY)


def ranges(keys: DataFrame, rows: int, total: int, rows_per_range: int) -> tuple[DataFrame, list]:
    """The keys with their range, and (range, bytes, rows) of each range."""
    n = min(MOST_RANGES, max(1, -(-rows // rows_per_range)))
    cuts, limit, seed = splitters(_draw(keys, n, total, 0), n), OVERFULL * max(rows_per_range, rows // n), 0
    while True:
        ranged = _ranged(keys, cuts)
        stats = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).orderBy("range").collect()
        full = [r for r in stats if r["rows"] > limit]
        seed += 1
        if not full or seed > 8:
            return ranged, stats
        inside = ranged.where(F.col("range").isin([r["range"] for r in full]))
        parts = sum(-(-r["rows"] // rows_per_range) for r in full)
        more = splitters(_draw(inside, parts, sum(r["bytes"] for r in full), seed), parts)
        cuts = np.unique(np.concatenate([cuts, more]))
        cuts = cuts[np.lexsort((cuts["d"], cuts["h"]))]


def shard(docs: DataFrame, n: int = 8, slack: float = 0.02, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    keys = stage(docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"),
    ), "shard-keys")
    rows, total = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranged, stats = ranges(keys, rows, total, rows_per_range)
    starts, at_byte, at_row = [], 0, 0
    for r in stats:
        starts.append((r["range"], at_byte, at_row))
        at_byte, at_row = at_byte + r["bytes"], at_row + r["rows"]
    # At most one row per range: MOST_RANGES and what overfull ranges add.
    offsets = F.broadcast(spark.createDataFrame(starts, "range int, first_byte long, first_row long"))
    inside = Window.partitionBy("range").orderBy("h", "d", "size")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = stage(ranged.join(offsets, "range").select(
        "doc_id", "size", "text_crc32", "h",
        (F.col("first_byte") + F.sum("size").over(so_far) - F.col("size")).alias("begin"),
        (F.col("first_row") + F.row_number().over(inside) - 1).alias("row"),
    ), "shard-places")
    begins = _begins(placed, n, total, slack)
    number = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in begins]), lambda b: b <= F.col("begin"))) if n > 1 else F.lit(0)
    sharded = placed.withColumn("shard", number.cast("int"))
    first = {r["shard"]: r["row"] for r in sharded.groupBy("shard").agg(F.min("row").alias("row")).collect()}
    base = F.array(*[F.lit(first.get(k, 0)).cast("long") for k in range(n)])
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("row") - base[F.col("shard")]).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _begins(placed: DataFrame, n: int, total: int, slack: float) -> list[int]:
    """The byte places at which shards 1 to n - 1 begin."""
    targets = [total * k // n for k in range(1, n)]
    if not total or not targets:
        return targets
    end = F.col("begin") + F.col("size")
    across = F.exists(F.array(*[F.lit(t).cast("long") for t in targets]), lambda t: (F.col("begin") <= t) & (t < end))
    rows = placed.where(across).select("h", "begin", end.alias("end")).collect()
    groups = placed.where(F.col("h").isin([r["h"] for r in rows])).groupBy("h").agg(
        F.min("begin").alias("begin"), F.max(end).alias("end")).collect()
    extent = {g["h"]: (g["begin"], g["end"]) for g in groups}
    out = []
    for t in targets:
        row = next(r for r in rows if r["begin"] <= t < r["end"])
        low, high = extent[row["h"]]
        if high - low > slack * total / n:
            low, high = row["begin"], row["end"]
        out.append(low if t - low <= high - t else high)
    return out
