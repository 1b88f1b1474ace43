"""Ordered per-key operators that survive a hot key.

A plain window sorts all rows of a key in one task. Here a key's rows are cut into segments of its order
(usually time spans); rows are sorted per (key, segment) and only one summary row per segment is ordered
per key.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.text import epoch_seconds

SEGMENT = "_segment"


def time_segment(column: str, seconds: float) -> Column:
    return F.floor(epoch_seconds(F.col(column)) / seconds)


def with_previous(
    rows: DataFrame, keys: list[str], order: list[str], segment: Column, values: list[str], prefix: str = "prev_"
) -> DataFrame:
    """Add the values of the preceding row of the same key, null for the first."""
    return _previous(rows.withColumn(SEGMENT, segment), keys, order, values, prefix).drop(SEGMENT)


def _previous(cut: DataFrame, keys: list[str], order: list[str], values: list[str], prefix: str) -> DataFrame:
    inside = Window.partitionBy(*keys, SEGMENT).orderBy(*order)
    # one plain order column keeps the summary a hash aggregate
    newest = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    tails = cut.groupBy(*keys, SEGMENT).agg(*[F.max_by(v, newest).alias(f"_tail_{v}") for v in values])
    along = Window.partitionBy(*keys).orderBy(SEGMENT)
    before = [F.lag(f"_tail_{v}").over(along).alias(f"_before_{v}") for v in values]
    tails = tails.select(*keys, SEGMENT, *before)
    placed = cut.withColumns(
        {"_place": F.row_number().over(inside)} | {f"_own_{v}": F.lag(v).over(inside) for v in values}
    )
    joined = placed.join(tails, [*keys, SEGMENT])
    added = {
        prefix + v: F.when(F.col("_place") == 1, F.col(f"_before_{v}")).otherwise(F.col(f"_own_{v}")) for v in values
    }
    spent = [f"_{kind}_{v}" for kind in ("own", "before") for v in values]
    return joined.withColumns(added).drop("_place", *spent)


def running_total(
    rows: DataFrame, keys: list[str], order: list[str], segment: Column, value: Column, name: str
) -> DataFrame:
    """Add the cumulative sum up to each row of its key."""
    return _total(rows.withColumn(SEGMENT, segment), keys, order, value, name).drop(SEGMENT)


def _total(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    cut = rows.withColumn("_value", value)
    inside = Window.partitionBy(*keys, SEGMENT).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*keys, SEGMENT).agg(F.sum("_value").alias("_sum"))
    shifts = sums.withColumn("_shift", F.sum("_sum").over(before)).drop("_sum")
    joined = cut.withColumn("_inside", F.sum("_value").over(inside)).join(shifts, [*keys, SEGMENT])
    total = F.col("_inside") + F.coalesce(F.col("_shift"), F.lit(0).cast(cut.schema["_value"].dataType))
    return joined.withColumn(name, total).drop("_value", "_inside", "_shift")


def runs(rows: DataFrame, keys: list[str], order: list[str], segment: Column, state: str) -> DataFrame:
    """Add `run`, the number of the unbroken stretch of equal state that a row belongs to."""
    marked = _previous(rows.withColumn(SEGMENT, segment), keys, order, [state], "_was_")
    change = (~F.col(f"_was_{state}").eqNullSafe(F.col(state))).cast("bigint")
    return _total(marked, keys, order, change, "run").drop(SEGMENT, f"_was_{state}")
