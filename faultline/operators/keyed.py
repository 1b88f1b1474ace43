"""Keyed tables: newest row per key, upsert, fallback reads, unions by missing key, numbering."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.text import instant
from faultline.operators.numbering import number_rows
from faultline.session import stage

# Packed order numbers: a time in microseconds before 20 digits that hold any 64-bit integer.
_TIMES = ("timestamp", "timestamp_ntz", "date")
_WHOLE = ("tinyint", "smallint", "int", "bigint")
_SHIFT, _OFFSET = 10**20, 2**63


def packed_order(rows: DataFrame, order: list[str]) -> Column | None:
    """One decimal that sorts like a time, an integer or a time and an integer (null first); None for other orders.

    Its minimum and maximum are hash aggregates, which those of a struct are not."""
    kinds = [rows.schema[name].dataType.simpleString() for name in order]
    micros = lambda name: F.coalesce(F.unix_micros(F.col(name).cast("timestamp")), F.lit(-10**17))
    whole = lambda name: F.coalesce(F.col(name).cast("bigint"), F.lit(-(2**63)))
    wide = lambda value: value.cast("decimal(38,0)")
    if len(order) == 1 and kinds[0] in (*_TIMES, *_WHOLE):
        return wide(micros(order[0]) if kinds[0] in _TIMES else whole(order[0]))
    if len(order) == 2 and kinds[0] in _TIMES and kinds[1] in _WHOLE:
        high = micros(order[0]).cast("decimal(18,0)") * F.lit(str(_SHIFT)).cast("decimal(21,0)")
        low = whole(order[1]).cast("decimal(19,0)") + F.lit(str(_OFFSET)).cast("decimal(19,0)")
        return wide(wide(high) + low)
    return None


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key; a hot key is reduced before the shuffle.

    With a time, an integer or both as the order, the newest place of each key is a hash aggregate of one number and
    only the rows at that place are compared; other orders reduce whole rows.
    """
    place = packed_order(rows, order)
    if place is None:
        rest = [name for name in rows.columns if name not in keys]
        newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
        return rows.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*rows.columns)
    placed = rows.withColumn("_place", place)
    marks = placed.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.max("_place").alias("_newest"))
    same = F.col("_place") == F.col("_newest")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    # Rows that tie for a key are limited to one before they meet.
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("_place"))
    found = placed.join(marks, same).withColumn("_n", first).filter("_n = 1")
    return found.select(*rows.columns)


def upsert_by_key(
    target: DataFrame, updates: DataFrame, key: str, order: list[str], as_of=None, top: int | None = None
) -> DataFrame:
    """One row per key: newest update wins, `id` and `created_at` stay, `updated_at` is set.

    Updates carry the key, the order columns and the columns they change. New keys are numbered in key order behind
    `top`, the largest id given so far (that of the target if not said); a target without `id` has no numbers.
    """
    now = instant(as_of)
    changed = [c for c in updates.columns if c in target.columns and c not in (key, "id", "created_at", "updated_at")]
    newest = latest_per_key(updates, [key], order).select(key, *[F.col(c).alias(f"_new_{c}") for c in changed])
    newest = newest.withColumn("_hit", F.lit(True))
    if "id" in target.columns:
        # It is read for the merge and for the numbers; the updates are reduced once.
        newest = stage(newest, "newest")
    merged = target.join(newest, key, "full_outer")
    if "id" in target.columns:
        fresh = number_rows(newest.join(target, key, "left_anti").select(key), [F.col(key)], "_number")
        before = target.agg(F.coalesce(F.max("id"), F.lit(0))).scalar() if top is None else F.lit(top)
        merged = merged.join(fresh.select(key, (F.col("_number") + before).alias("_id")), key, "left")
    hit = F.col("_hit").isNotNull()

    def value(name: str) -> Column:
        if name == "id":
            return F.coalesce(F.col("id"), F.col("_id"))
        if name == "created_at":
            return F.coalesce(F.col("created_at"), now)
        if name == "updated_at":
            return F.when(hit, now).otherwise(F.col("updated_at"))
        if name in changed:
            return F.when(hit, F.col(f"_new_{name}")).otherwise(F.col(name))
        return F.col(name)

    return merged.select(*[value(name).alias(name) for name in target.columns])


def read_with_fallback(
    primary: DataFrame, secondary: DataFrame, key: str, mode: str = "per_key"
) -> DataFrame:
    """Primary rows, and secondary rows for missing keys (or all of them when primary is empty)."""
    if mode == "per_key":
        return primary.unionByName(secondary.join(primary, key, "left_anti"))
    if mode == "when_empty":
        return secondary if primary.isEmpty() else primary
    raise ValueError(f"unknown mode {mode}")


def lookup_by_key(rows: DataFrame, column: str, value) -> DataFrame:
    """Rows of one key value, or of all keys of a one-column DataFrame."""
    if isinstance(value, DataFrame):
        keys = value.toDF(column)
        return rows.join(keys, column, "left_semi")
    return rows.filter(F.col(column) == F.lit(value))


def exclude_self(rows: DataFrame, column: str, current) -> DataFrame:
    return rows.filter(F.col(column) != F.lit(current))


def merge_list(rows: DataFrame, updates: DataFrame, key: str, position: str) -> DataFrame:
    """Replace listed rows by their update in place; new rows go before all others."""
    old = rows.select(key, F.col(position).alias("_position"))
    front = rows.agg(F.coalesce(F.min(position), F.lit(0)) - 1).scalar()
    placed = updates.drop(position).join(old, key, "left")
    placed = placed.withColumn(position, F.coalesce(F.col("_position"), front)).select(*rows.columns)
    return rows.join(updates, key, "left_anti").unionByName(placed)


def union_defaults(rows: DataFrame, column: str, defaults: list[str]) -> DataFrame:
    """Distinct non-null values of a column together with fixed values."""
    fixed = F.explode(F.array(*[F.lit(value) for value in defaults]))
    extra = rows.sparkSession.range(1).select(fixed.alias(column))
    return rows.select(column).filter(F.col(column).isNotNull()).union(extra).distinct()


def vector_or(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """All of left, and the series of right whose labels left does not have.

    Every row of the chosen side stays, also where one label set comes more than once. A null label equals no other, so
    such rows stay on both sides. One window finds the side, so each side is computed once.
    """
    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    placed = both.withColumn("_first", F.min("_side").over(Window.partitionBy(*on)))
    unequal = reduce(or_, [F.col(name).isNull() for name in on])
    return placed.filter((F.col("_side") == F.col("_first")) | unequal).drop("_side", "_first")


def vector_divide(left: DataFrame, right: DataFrame, on: list[str], floor: float | None = None) -> DataFrame:
    """One-to-one division of two vectors on equal labels."""
    below = right.select(*on, F.col("value").alias("_below"))
    divisor = F.col("_below") if floor is None else clamp_min(F.col("_below"), floor)
    joined = left.join(below, on)
    return joined.withColumn("value", F.try_divide("value", divisor)).drop("_below")


def clamp_min(value: Column, floor: float) -> Column:
    return F.greatest(value, F.lit(floor))
