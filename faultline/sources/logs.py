"""Log events, alert documents and metric samples: readers, unified layout, sinks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schemas
from faultline.functions.text import instant

CORRUPT = "_corrupt_record"
EVENT_TIME = "@timestamp"
DAY = "yyyy.MM.dd"
NO_TRACE = "none"


def _named(records: DataFrame) -> DataFrame:
    rest = [c for c in records.columns if c != EVENT_TIME]
    return records.select(F.col(f"`{EVENT_TIME}`").cast("timestamp_ntz").alias("ts"), *rest)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line; a broken line keeps its text in `_corrupt_record`."""
    return _named(
        spark.read.schema(f"{schemas.LOG_JSON}, {CORRUPT} string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


def read_log_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """The same events as a stream of arriving files."""
    return _named(spark.readStream.schema(schemas.LOG_JSON).options(**options).json(path))


def parse_log_records(records: DataFrame, column: str = "value") -> DataFrame:
    """Events out of a text or binary record column, as a message queue delivers them."""
    event = F.from_json(F.col(column).cast("string"), schemas.LOG_JSON).alias("event")
    return _named(records.select(event).select("event.*"))


def to_json_lines(logs: DataFrame) -> DataFrame:
    """Events as JSON text, one object per row."""
    rest = [c for c in logs.columns if c != "ts"]
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(EVENT_TIME)
    return logs.select(F.to_json(F.struct(stamp, *rest)).alias("value"))


def read_alert_payloads(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """One JSON document per line as text, with a `payload_id` made of file and text, the same on every read.

    A document that stands twice in a file is the same document.
    """
    reader = spark.readStream if stream else spark.read
    return reader.text(path).select(
        F.xxhash64("_metadata.file_path", "value").alias("payload_id"), F.col("value").alias("payload")
    )


def read_metric_samples(spark: SparkSession, path: str, stream: bool = False, format: str = "parquet") -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(schemas.METRIC_SAMPLE).format(format).load(path)


def unify_log_layouts(composite: DataFrame, encoder: DataFrame) -> DataFrame:
    """Both event layouts in one; absent columns are null, a missing trace id is `none`.

    The encoder's layout writes exception text as `stack_trace`.
    """
    both = composite.unionByName(encoder, allowMissingColumns=True)
    if "stack_trace" in both.columns:
        own = [F.col("exception")] if "exception" in both.columns else []
        both = both.withColumn("exception", F.coalesce(*own, "stack_trace")).drop("stack_trace")
    return both.withColumn("trace_id", F.coalesce("trace_id", F.lit(NO_TRACE)))


def upper_log_level(logs: DataFrame) -> DataFrame:
    return logs.withColumn("log_level", F.upper(F.coalesce("log_level", "level")))


def add_ingested_at(logs: DataFrame, as_of=None) -> DataFrame:
    return logs.withColumn("ingested_at", instant(as_of))


def with_event_day(logs: DataFrame) -> DataFrame:
    return logs.withColumn("event_day", F.date_format("ts", DAY))


def write_daily_logs(logs: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet partitioned by event day.

    The rebalance brings the rows of a day together, so files stay few, and splits a day that is too large.
    """
    daily = with_event_day(logs).hint("rebalance", "event_day")
    daily.write.mode(mode).partitionBy("event_day").parquet(path)


def read_daily_logs(spark: SparkSession, path: str, day_from: str, day_to: str) -> DataFrame:
    """Events of a range of days; only those partitions are read."""
    logs = spark.read.option("recursiveFileLookup", "false").parquet(path)
    return logs.filter(F.col("event_day").cast("string").between(day_from, day_to))


def fan_out_logs(batch: DataFrame, table_path: str, lines_path: str, number: int = 0) -> None:
    """Write one batch to the daily table and to a JSON-lines sink.

    The batch number is a folder of both, so a batch that runs again replaces itself.
    """
    kept = batch.persist()
    write_daily_logs(kept, f"{table_path}/batch={number}", "overwrite")
    to_json_lines(kept).write.mode("overwrite").text(f"{lines_path}/batch={number}")
    kept.unpersist()
