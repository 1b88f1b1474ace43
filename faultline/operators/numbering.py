"""Consecutive numbers in a total order without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.session import stage

#: Rows in one sorted range; ranges follow the number of rows, not the width of the key.
ROWS_PER_RANGE = 200_000
#: `monotonically_increasing_id` keeps the partition above, the row's place in it below this bit.
PLACE_BITS = 33


def number_rows(rows: DataFrame, order: list[Column], name: str = "n", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add 1, 2, 3, ... in the given order as `name`.

    Spark samples the order's keys, cuts ranges of about equal row counts and sorts each; the rows before a range are a
    sum over one number per range. Ties get consecutive numbers; they are broken by a row mark, so a key that many rows
    share is divided too. Rows are staged, so a repeated task gives the same numbers.
    """
    stored = stage(rows, "rows")
    ranges = max(1, -(-stored.count() // rows_per_range))
    marked = stored.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    ranged = marked.repartitionByRange(ranges, *order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    placed = stage(ranged.withColumn("_place", F.monotonically_increasing_id()), "placed")
    return number_places(placed, "_place", name).drop("_place")


def number_places(placed: DataFrame, place: str, name: str) -> DataFrame:
    """Add 1, 2, 3, ... as `name` from stored partition places (`monotonically_increasing_id`); one row per partition is collected."""
    of = F.shiftright(place, PLACE_BITS)
    before, starts = 0, []
    for r in placed.groupBy(of.alias("_range")).count().orderBy("_range").collect():
        starts.append((r["_range"], before))
        before += r["count"]
    offsets = F.broadcast(placed.sparkSession.createDataFrame(starts, "_range long, _before long"))
    number = F.col("_before") + F.col(place).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1
    return placed.withColumn("_range", of).join(offsets, "_range").withColumn(name, number).drop("_range", "_before")
