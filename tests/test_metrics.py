"""Counters, alert rules and streams."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faultline import schemas
from faultline.operators import metrics, rules
from faultline.session import scratch
from faultline.sources import logs as sources
from faultline.streaming import jobs

START = datetime(2026, 1, 1)


def samples(spark, points, metric="c", labels=None):
    rows = [(START + timedelta(seconds=s), metric, labels or {"job": "j"}, float(v)) for s, v in points]
    return spark.createDataFrame(rows, schemas.METRIC_SAMPLE)


@pytest.mark.parametrize("step", [120.0, 60.0, 30.0, 15.0])
def test_increase_repairs_resets(spark, step):
    df = samples(spark, [(15, 5), (30, 8), (45, 2), (60, 4)])
    rows = {r.eval_ts: r.value for r in metrics.counter_increase(df, 120.0, step).collect()}
    assert rows[START + timedelta(seconds=120)] == 7.0


def test_one_sample_gives_no_rate(spark):
    assert metrics.counter_rate(samples(spark, [(15, 5)]), 120.0).count() == 0


def test_extrapolation(spark):
    df = samples(spark, [(15 * i, 10 * i) for i in range(1, 9)])
    row = metrics.counter_increase(df, 120.0, extrapolate=True).filter("value > 0").first()
    # seven gaps of 15 s were seen; the 15 s before the first sample are near enough to be added
    assert row.value == pytest.approx(80.0)


def test_label_rename(spark):
    df = samples(spark, [(15, 5), (30, 8)], labels={"httpStatusCode": "500"})
    labels = df.select(metrics.rename_label(F.col("labels"), "httpStatusCode", "status").alias("l")).first().l
    assert labels == {"httpStatusCode": "500", "status": "500"}


def up(spark, points):
    return samples(spark, points, "up", {"job": "user-service"})


@pytest.mark.parametrize("segment", [10.0, 3600.0])
def test_outage_needs_its_pending_time(spark, segment):
    short = [(0, 1), (10, 0), (20, 0), (30, 0), (40, 1)]
    long = [(0, 1), (10, 0), (20, 0), (30, 0), (40, 0), (50, 1)]
    assert rules.service_down_alerts(up(spark, short), 30.0, segment).count() == 0
    (row,) = rules.service_down_alerts(up(spark, long), 30.0, segment).collect()
    assert row.alertname == "UserServiceDown" and row.fired_at == START + timedelta(seconds=40)


def logs(spark, *rows):
    return spark.createDataFrame(
        [(START + timedelta(seconds=s), level, message) for s, level, message in rows], "ts timestamp_ntz, level string, message string"
    )


def test_log_rules(spark):
    df = logs(
        spark,
        (0, "ERROR", "PAYMENT_TIMEOUT service=payment-service"), (1, "ERROR", "Connection refused while connecting to postgres"),
        (2, "WARN", "LOGIN_FAILED username=x"), (3, "INFO", "Exception while processing"),
        (4, "INFO", "java.lang.NullPointerException"), (5, None, None),
    )
    hits = rules.log_rule_hits(df).groupBy("rule").count().collect()
    assert {r.rule: r["count"] for r in hits} == {
        "Payment Timeout": 1, "Database Failure": 1, "Login Failure": 1, "Java Exception": 3,
    }


def test_notifications(spark):
    df = logs(spark, (0, "", "a"), (5, "", "a"), (25, "", "a"), (400, "", "a")).withColumn("g", F.lit("x"))
    rows = rules.group_notifications(df, ["g"], repeat=120.0, lifetime=300.0).orderBy("sent_at").collect()
    found = [((r.sent_at - START).total_seconds(), r.kind, r.new_alerts) for r in rows]
    assert found == [
        (10, "first", 2), (40, "change", 1), (160, "repeat", 0), (280, "repeat", 0),
        (410, "first", 1), (530, "repeat", 0), (650, "repeat", 0),
    ]


def test_broken_lines_keep_their_text(spark):
    path = scratch(spark, "lines")
    lines = ['{"@timestamp": "2026-01-01T00:00:00.5Z", "level": "INFO", "message": "ok"}', "broken {"]
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    rows = sources.read_json_lines(spark, path).collect()
    good = [r for r in rows if r.level]
    assert good[0].ts == datetime(2026, 1, 1, 0, 0, 0, 500000)
    assert [r._corrupt_record for r in rows if r._corrupt_record] == ["broken {"]


def test_ingest_in_several_batches(spark):
    path, table, lines, progress = (scratch(spark, name) for name in ("in", "table", "out", "progress"))
    for day in range(3):
        events = [(START + timedelta(days=day, hours=h), "warn", None, "l", "s", None, f"m{h}", None) for h in range(4)]
        df = spark.createDataFrame(events, schemas.LOG_EVENT)
        sources.to_json_lines(df).coalesce(1).write.mode("append").text(path)
        stream = sources.read_log_stream(spark, path, maxFilesPerTrigger=1)
        jobs.ingest_logs(stream, table, lines, progress, "2026-02-01 00:00:00").awaitTermination()
    stored = spark.read.parquet(table)
    assert stored.count() == 12 and stored.select("log_level").distinct().first()[0] == "WARN"
    assert sources.read_json_lines(spark, lines).count() == 12
    assert sources.read_daily_logs(spark, table, "2026.01.02", "2026.01.02").count() == 4


def test_state_changes_as_stream_in_steps(spark):
    from faultline.streaming import stateful

    path, out, progress = (scratch(spark, name) for name in ("in", "out", "progress"))
    found = None
    # A run counts once the watermark has passed it; the last one is there to move the watermark.
    for minutes in ([1, 2], [3, 9], [600], [2000]):
        runs = [("r", START + timedelta(minutes=m)) for m in minutes]
        spark.createDataFrame(runs, "rule string, run_at timestamp_ntz").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema("rule string, run_at timestamp_ntz").parquet(path)
        changes = stateful.on_state_change(stream, 60.0)
        query = (
            changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    found = sorted((int((r.changed_at - START).total_seconds() / 60), r.state) for r in spark.read.parquet(out).collect())
    assert found == [(1, "active"), (4, "inactive"), (9, "active"), (10, "inactive"), (600, "active"), (601, "inactive")]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    table, lines = str(tmp_path / "table"), str(tmp_path / "lines")
    logs = spark.createDataFrame([(START, "INFO", "m")], "ts timestamp_ntz, level string, message string")
    for number in (0, 0, 1):
        sources.fan_out_logs(logs, table, lines, number)
    assert sources.read_daily_logs(spark, table, "2026.01.01", "2026.01.01").count() == 2
    assert sources.read_json_lines(spark, lines).count() == 2


def test_a_sample_without_a_number_is_an_error(spark):
    rows = [(START, "up", {"job": job}, value) for job, value in (("a", None), ("b", float("nan")), ("c", 1.0), ("d", 0.0))]
    df = spark.createDataFrame(rows, schemas.METRIC_SAMPLE)
    states = {r.job: r.state for r in rules.no_data_state(df, [*"abcde"], START, 600.0).collect()}
    assert states == {"a": "Alerting", "b": "Alerting", "c": "OK", "d": "Alerting", "e": "NoData"}


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from faultline.session import drop_staged, shared_folder, stage

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", applicationId="app")
    away = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(away)
    assert stage(spark.range(3), "three").count() == 3 and drop_staged(spark) > 0 and drop_staged(spark) == 0
