"""Document fingerprints: the smallest `SIZE` hashes of a text's word shingles, in DataFrame functions only.

Sketches of parts merge into the sketch of the whole: the smallest hashes of both. From two sketches come the
resemblance (shared shingles over all), the containment of one text in the other and, from one, the number of
distinct shingles.

Words are pieces between white space, lower-cased; fewer than `k` words are one shingle. A null or empty text, or one
of white space, has an empty sketch; two empty sketches resemble each other fully, an empty and another one not at all.
Repeated rows and texts have equal sketches each on their own. A very long text is split whole: its words and their hashes lie in
arrays of one row, so it must fit a task. The next document is found in ranges of doc_ids; rows that share a doc_id lie in one
range, in the order of a hash of their texts, as do those with a null doc_id, which come first. Other columns stay where a column is added and are
left out of the comparison with edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import cuts_of, range_of

SIZE = 128
ROWS_PER_RANGE = 2048


def with_sketch(df: DataFrame, text: str, name: str, k: int = 5, size: int = SIZE) -> DataFrame:
    """Add the sketch of a text column as an ascending array of hashes."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    hashed, shingled = f"_{name}_words", f"_{name}_shingles"
    df = df.withColumn(hashed, F.transform(words, lambda w: F.xxhash64(w)))
    h, n = F.col(hashed), F.size(hashed)
    each = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
    df = df.withColumn(shingled, F.when(n >= k, each).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>")))
    return df.withColumn(name, F.slice(F.sort_array(F.array_distinct(shingled)), 1, size)).drop(hashed, shingled)


def union(a: Column, b: Column, size: int = SIZE) -> Column:
    """The sketch of both texts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Shared shingles over all shingles of two texts, 0 to 1."""
    both, top = F.array_intersect(a, b), F.element_at(union(a, b, size), -1)
    total = F.size(union(a, b, size))
    return F.when(total == 0, 1.0).otherwise(F.size(F.filter(both, lambda x: x <= top)) / total)


def distinct_count(a: Column, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles; exact below the sketch's size."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) / share)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Share of the first text's shingles that the second has, 0 to 1; 1 for an empty first text."""
    shared = resemblance(a, b, size) * distinct_count(union(a, b, size), size)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, size)))


def merge(parts: DataFrame, key: str, sketch: str, size: int = SIZE) -> DataFrame:
    """One sketch per key. Each task passes on at most `size` hashes of a key, so a hot key costs no more."""
    hashes = parts.select(key, F.explode(sketch).alias("h")).distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy("h"))
    kept = hashes.withColumn("rank", rank).where(F.col("rank") <= size)
    return kept.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(sketch))


def printed(sketch: Column) -> Column:
    return F.lower(F.concat_ws(",", F.transform(sketch, lambda x: F.hex(x))))


def with_next(docs: DataFrame, carried: list[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add next_<column> from the next row by ascending doc_id; after the last comes the first.

    Rows are dealt into ranges of doc_id and ordered in each; the first row of a range also goes, as a guest, to the
    range before it. Null doc_ids come first; equal ones are ordered by a hash of the text."""
    cuts = cuts_of(docs, "doc_id", rows_per_range)
    ids = docs.select(range_of(F.col("doc_id"), cuts).alias("r"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"))
    # One row per range, at most as many as cuts_of allows.
    first = {row["r"]: row["d"] for row in ids.groupBy("r").agg(F.min("d").alias("d")).collect()}
    rows = docs.withColumn("_range", range_of(F.col("doc_id"), cuts)).withColumn("_order", F.xxhash64("text"))
    order = sorted(first)
    host = {r: order[i - 1] for i, r in enumerate(order)}
    is_first = F.lit(False)
    if first:
        least = F.create_map(*[F.lit(x) for r in order for x in (r, first[r])])
        before = F.create_map(*[F.lit(x) for r in order for x in (r, host[r])])
        is_first = F.coalesce("doc_id", F.lit(-(1 << 63))) == least[F.col("_range")]
        places = F.when(is_first, F.array(
            F.struct(F.col("_range").alias("range"), F.lit(0).alias("guest")),
            F.struct(before[F.col("_range")].alias("range"), F.lit(1).alias("guest")),
        )).otherwise(F.array(F.struct(F.col("_range").alias("range"), F.lit(0).alias("guest"))))
    else:
        places = F.array(F.struct(F.col("_range").alias("range"), F.lit(0).alias("guest")))
    # One struct in one window over plain columns, so texts are shuffled once.
    rows = rows.withColumn("_place", F.explode(places)).select(
        *docs.columns, "_order", F.col("_place.range").alias("_host"), F.col("_place.guest").alias("_guest"))
    window = Window.partitionBy("_host").orderBy("_guest", "doc_id", "_order")
    rows = rows.withColumn("_next", F.lead(F.struct(*carried)).over(window)).where("_guest = 0")
    return rows.select(*docs.columns, *[F.col(f"_next.{name}").alias(f"next_{name}") for name in carried])


def compare_with_edits(docs: DataFrame, k: int = 5, size: int = SIZE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(with_sketch(rows, "text", "own", k, size), ["text", "own"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    rows = with_sketch(rows, "edited", "other", k, size)
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("own")).alias("fingerprint"), printed(F.col("other")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("other"), size).alias("near_edited"),
        resemblance(F.col("own"), F.col("next_own"), size).alias("near_next"),
    )
