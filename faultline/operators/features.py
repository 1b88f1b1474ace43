"""Numeric features of parsed logs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions.text import empty_to_null
from faultline.operators.keyed import union_defaults
from faultline.operators.numbering import number_rows

ENCODED = {"service": ("service_name", C.SERVICES), "failure_type": ("failure_type", C.FAILURE_TYPES)}


def fit_encoders(parsed: DataFrame) -> DataFrame:
    """Index of every class per encoder in code-point order: observed, default and UNKNOWN classes."""
    parts = [
        union_defaults(parsed.withColumnRenamed(column, "class"), "class", [*defaults, C.UNKNOWN_CLASS])
        .select(F.lit(name).alias("encoder"), "class")
        for name, (column, defaults) in ENCODED.items()
    ]
    # Classes come from free text, so they are numbered in ranges; an encoder's first number is one row.
    numbered = number_rows(parts[0].union(parts[1]), [F.col("encoder"), F.col("class")], "_n")
    first = numbered.groupBy("encoder").agg(F.min("_n").alias("_first"))
    return numbered.join(F.broadcast(first), "encoder").select("encoder", "class", (F.col("_n") - F.col("_first")).cast("int").alias("idx"))


def encode(rows: DataFrame, encoders: DataFrame, name: str, column: str, target: str) -> DataFrame:
    """Add the class index; blank and unseen classes take the index of UNKNOWN, no encoder gives 0.

    The class table is a plain join side: its size decides whether Spark broadcasts it.
    """
    own = encoders.filter(F.col("encoder") == name)
    classes = own.select(F.col("class").alias("_class"), F.col("idx").alias("_idx"))
    unknown = own.filter(F.col("class") == C.UNKNOWN_CLASS).agg(F.max("idx")).scalar()
    value = F.coalesce(empty_to_null(F.col(column)), F.lit(C.UNKNOWN_CLASS))
    joined = rows.withColumn("_value", value).join(classes, F.col("_value") == F.col("_class"), "left")
    index = F.coalesce(F.col("_idx"), unknown, F.lit(0)).cast("float")
    return joined.withColumn(target, index).drop("_value", "_class", "_idx")


def status_feature(status: Column) -> Column:
    return F.coalesce(status.try_cast("int"), F.lit(0)).cast("float")


def is_error(level: Column) -> Column:
    return F.when(F.upper(level).isin(C.ERROR_LEVELS), 1.0).otherwise(0.0).cast("float")


def hour_of_day(ts: Column) -> Column:
    """Hour as written; a time text keeps its own wall clock, unreadable text gives 0."""
    wall = F.regexp_replace(ts.cast("string"), r"(Z|[+-][0-9]{2}:?[0-9]{2})$", "").try_cast("timestamp_ntz")
    return F.coalesce(F.hour(wall), F.lit(0)).cast("float")


def hour_feature(rows: DataFrame, column: str) -> Column:
    if rows.schema[column].dataType.typeName() == "timestamp_ntz":
        return F.coalesce(F.hour(column), F.lit(0)).cast("float")
    return hour_of_day(F.col(column))


def build_feature_matrix(parsed: DataFrame, encoders: DataFrame) -> DataFrame:
    """The six float features of each parsed log, in fixed order."""
    rows = encode(parsed, encoders, "service", "service_name", "service_idx")
    rows = encode(rows, encoders, "failure_type", "failure_type", "failure_idx")
    message = F.length(F.coalesce("error_message", F.lit(""))).cast("float")
    return rows.select(
        "incident_id",
        status_feature(F.col("status_code")).alias("status_code"),
        is_error(F.col("log_level")).alias("is_error"),
        "service_idx",
        "failure_idx",
        hour_feature(parsed, "log_timestamp").alias("hour_of_day"),
        message.alias("error_msg_length"),
    )


def feature_vector(matrix: DataFrame) -> DataFrame:
    return matrix.select("incident_id", F.array(*C.FEATURES).alias("features"))
