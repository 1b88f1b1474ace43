"""Raw log text to parsed log rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions import logfields as L
from faultline.functions.text import empty_to_null

PARSED = [
    "incident_id", "service_name", "log_level", "error_message", "exception_type", "status_code",
    "trace_id", "failure_type", "log_timestamp", "raw_log",
]


def parse_logs(requests: DataFrame, zone: str = "UTC") -> DataFrame:
    """All fields of each request's raw log; the request's own values are fallbacks.

    Plain column expressions: no shuffle, and the same plan on a stream. Each pattern is searched once,
    in a projection of its own, because later rules read its capture several times.
    """
    col = F.col
    kept = [name for name in requests.columns if name not in PARSED and name != "timestamp"]
    captured = requests.withColumns({f"_{name}": L.capture("raw_log", name) for name in L.PATTERNS})
    found = captured.withColumns(
        {
            "_exception": empty_to_null(col("_exception")),
            "_status": F.coalesce(col("_status").try_cast("int"), col("status_code").cast("int")),
        }
    ).withColumn("_marker", F.instr("raw_log", F.concat("_exception", F.lit(":"))))
    read = found.withColumn(
        "_text",
        L.error_message(col("raw_log"), col("_exception"), col("_marker"), col("_message"), col("error_message")),
    )
    lowered = read.withColumns(
        {
            "_everything": L.everything(col("raw_log"), col("_exception"), col("_text")),
            "_named": F.coalesce(empty_to_null(col("_failure")), empty_to_null(col("failure_type"))),
        }
    ).withColumn("_cleaned", L.cleaned_name(col("_named")))
    return lowered.select(
        *kept,
        "incident_id",
        F.coalesce(empty_to_null(col("_service")), col("service_name")).alias("service_name"),
        empty_to_null(col("_level")).alias("log_level"),
        col("_text").alias("error_message"),
        col("_exception").alias("exception_type"),
        col("_status").alias("status_code"),
        F.coalesce(empty_to_null(col("_trace")), col("trace_id")).alias("trace_id"),
        F.when(col("_named").isNotNull(), F.coalesce(empty_to_null(col("_cleaned")), F.lit(C.DEFAULT_FAILURE)))
        .otherwise(L.failure_by_rule(col("_everything"), col("_status")))
        .alias("failure_type"),
        F.coalesce(L.parse_log_datetime(col("_timestamp"), zone), col("timestamp")).alias("log_timestamp"),
        "raw_log",
    )


def failure_counts(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("service_name", "failure_type").agg(
        F.count("*").alias("logs"),
        F.count_if(F.col("status_code") >= 500).alias("server_errors"),
        F.max("log_timestamp").alias("last_seen"),
    )


def parse_quality(parsed: DataFrame, incidents: DataFrame) -> DataFrame:
    """Rows with no value per field, and incidents by parser status, in one row."""
    fields = [name for name in PARSED if name not in ("incident_id", "raw_log")]
    nulls = F.struct(
        F.count("*").alias("logs"),
        *[F.count_if(F.col(name).isNull()).alias(f"{name}_missing") for name in fields],
    )
    status = F.upper(F.trim("parser_status"))
    tiles = incidents.agg(
        F.count_if(status == "COMPLETED").alias("parsed"),
        F.count_if(status == "FAILED").alias("failed"),
        F.count_if(status == "PENDING").alias("pending"),
    )
    return tiles.withColumn("_nulls", parsed.agg(nulls).scalar()).select("*", "_nulls.*").drop("_nulls")
