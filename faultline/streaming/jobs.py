"""Streaming forms of the batch operators.

Stateless operators (parsing, normalisation, enrichment, routing) are the batch functions applied to a
stream. Here are the jobs that need a watermark, a sink or several writes.
"""

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from faultline.operators import alerts, forest, keyed, parsing, rules
from faultline.session import scratch, stage
from faultline.sources import logs as sources
from faultline.sources import store

LATENESS = "5 minutes"


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything that has arrived and return the written table."""
    spark = stream.sparkSession
    path, progress = scratch(spark, name), scratch(spark, f"{name}-progress")
    query = (
        stream.writeStream.queryName(name)
        .format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def for_each_batch(
    stream: DataFrame, work: Callable[[DataFrame, int], None], progress: str, once: bool = True
) -> StreamingQuery:
    """Start a job that hands every micro-batch to `work`; progress survives restarts."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", progress)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest_logs(stream: DataFrame, table_path: str, lines_path: str, progress: str, as_of=None) -> StreamingQuery:
    """Normalise levels, stamp arrival and write each batch to the daily table and the JSON-lines sink."""
    enriched = sources.add_ingested_at(sources.upper_log_level(stream), as_of)
    return for_each_batch(
        enriched, lambda batch, number: sources.fan_out_logs(batch, table_path, lines_path, number), progress
    )


def upsert_stream(
    stream: DataFrame, path: str, schema: str, key: str, order: list[str], progress: str, as_of=None,
    name: str = "rows", source: str = "stream",
) -> StreamingQuery:
    """Keep a stored table with one row per key: a batch rewrites the buckets it touches, a repeated one nothing."""
    store.create(stream.sparkSession, path, {name: (schema, key)})

    def work(batch: DataFrame, number: int) -> None:
        store.commit(batch.sparkSession, path, {name: (batch, order)}, source, number, as_of)

    return for_each_batch(stream, work, progress)


def with_event_time(rows: DataFrame, lateness: str, column: str = "ts") -> DataFrame:
    """Watermark on the event time, which streams keep as an instant (UTC session)."""
    return rows.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def _wall(rows: DataFrame, column: str = "run_at") -> DataFrame:
    return rows.withColumn(column, F.col(column).cast("timestamp_ntz"))


def log_pattern_alerts(
    logs: DataFrame, length: str = "5 minutes", slide: str = "1 minute", lateness: str = LATENESS, **options
) -> DataFrame:
    """Sliding rule counts; a window is reported once it can no longer change."""
    return _wall(rules.log_pattern_alerts(with_event_time(logs, lateness), length, slide, **options))


def login_failure_alerts(logs: DataFrame, length: str = "1 minute", lateness: str = LATENESS) -> DataFrame:
    return _wall(rules.login_failure_alerts(with_event_time(logs, lateness), length))


def first_hits(logs: DataFrame, key: str, lateness: str = LATENESS) -> DataFrame:
    """Rule hits without repeats of the same event, for sources that deliver more than once."""
    hits = rules.log_rule_hits(with_event_time(logs, lateness))
    return hits.dropDuplicatesWithinWatermark([key, "rule"])


def score_stream(parsed: DataFrame, encoders: DataFrame, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Anomaly results of arriving parsed logs, scored by a stored forest."""
    return forest.score_isolation_forest(forest.build_feature_matrix(parsed, encoders), *model)


def alerts_to_incidents(
    payloads: DataFrame,
    folder: str,
    progress: str,
    encoders: DataFrame | None = None,
    model: tuple[DataFrame, DataFrame] | None = None,
    as_of=None,
) -> StreamingQuery:
    """Alert documents to incidents, parsed logs and anomaly results, kept as one row per incident.

    A micro-batch commits all its tables as one version of the store in `folder`, so readers never see an incident
    without its log. A document that comes again updates its rows, and a batch that runs again changes nothing.
    """
    spark = payloads.sparkSession

    def tables_of(batch: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = stage) -> dict[str, DataFrame]:
        # A document is chosen before it is read: the rest is one narrow pass, and all tables have one row per document.
        order = "received_at" if "received_at" in batch.columns else "payload"
        newest = keyed.latest_per_key(alerts.accepted(batch), ["payload_id"], [order])
        rows = alerts.normalize_alerts(newest, as_of)
        incident = F.struct(*alerts.incident_columns())
        logs = keep(parsing.parse_logs(alerts.parse_requests(rows, incident=incident)), "alerts")
        parsed = logs.drop("incident")
        incidents = alerts.parsed_incidents(logs, as_of)
        found = {"incidents": incidents.withColumn("incident_id", F.col("id")), "parsed_logs": parsed}
        if encoders is not None:
            found["anomaly_results"] = keep(forest.judge_logs(parsed, encoders, model), "results")
        return {name: _stored_shape(table) for name, table in found.items()}

    def work(batch: DataFrame, number: int) -> None:
        changes = {name: (table, None) for name, table in tables_of(batch).items()}
        store.commit(spark, folder, changes, "alerts", number, as_of)

    empty = tables_of(spark.createDataFrame([], payloads.schema), lambda table, _: table)
    store.create(spark, folder, {name: (_ddl(table), "incident_id") for name, table in empty.items()})
    return for_each_batch(payloads, work, progress)


def _stored_shape(table: DataFrame) -> DataFrame:
    """The rows with the columns that a stored table sets itself; an alert's own time stays as `opened_at`."""
    own = [c for c in table.columns if c not in ("id", "created_at", "updated_at")]
    opened = [F.col("created_at").alias("opened_at")] if "created_at" in table.columns else []
    none = F.lit(None).cast("timestamp_ntz")
    return table.select(*own, *opened, none.alias("created_at"), none.alias("updated_at"))


def _ddl(table: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)


class LateRows(StreamingQueryListener):
    """Adds up the rows that jobs drop because they come behind the watermark."""

    def __init__(self):
        self.dropped: dict[str, int] = {}
        self.running: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(event.name or str(event.id), 0)
        self.running.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        name = event.progress.name or str(event.progress.id)
        late = sum(state.numRowsDroppedByWatermark for state in event.progress.stateOperators)
        self.dropped[name] = self.dropped.get(name, 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.running.discard(str(event.runId))

    def table(self, spark: SparkSession, wait: float = 60.0) -> DataFrame:
        """job, dropped of every job that has started; waits for the last reports of those that have ended."""
        until = time.monotonic() + wait
        while self.running and time.monotonic() < until:
            time.sleep(0.05)
        return spark.createDataFrame(sorted(self.dropped.items()), "job string, dropped bigint")


@contextmanager
def late_rows(spark: SparkSession) -> Iterator[LateRows]:
    """Count late rows of the jobs that run inside."""
    listener = LateRows()
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)
