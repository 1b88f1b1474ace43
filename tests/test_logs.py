"""Log parsing and alert normalisation on single cases."""

import json
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from faultline import schemas
from faultline.functions import alertfields, logfields
from faultline.functions.labels import has_phrase
from faultline.operators import alerts, parsing

AS_OF = "2026-07-20 00:00:00"


def parse(spark, raw, service=None, timestamp=None, trace=None, status=None, failure=None, message=None):
    row = (1, raw, service, timestamp, trace, status, failure, message)
    return parsing.parse_logs(spark.createDataFrame([row], schemas.PARSE_REQUEST)).first()


def one(spark, value, function, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(function(F.col("v"))).first()[0]


def normalize(spark, *documents, mode="first"):
    rows = [(i, d if isinstance(d, str) else json.dumps(d), None) for i, d in enumerate(documents)]
    df = alerts.normalize_alerts(spark.createDataFrame(rows, schemas.ALERT_PAYLOAD), AS_OF, mode)
    return df.orderBy("payload_id", "alert_index").collect()


def test_full_extraction(spark):
    row = parse(
        spark,
        "2026-07-12 10:15:00 ERROR service=user-service traceId=trace-parser-test status=500 failure=server_error "
        "java.lang.IllegalStateException: User service is down",
    )
    assert row.log_timestamp == datetime(2026, 7, 12, 10, 15)
    assert (row.service_name, row.log_level, row.error_message) == ("user-service", "ERROR", "User service is down")
    assert row.exception_type == "java.lang.IllegalStateException"
    assert (row.status_code, row.trace_id, row.failure_type) == (500, "trace-parser-test", "SERVER_ERROR")


def test_fallbacks(spark):
    row = parse(
        spark, "payment validation failed", "payment-service", None, "fallback-trace", 402, "payment blocked",
        "Card was blocked",
    )
    assert (row.service_name, row.trace_id, row.status_code) == ("payment-service", "fallback-trace", 402)
    assert (row.failure_type, row.error_message) == ("PAYMENT_BLOCKED", "Card was blocked")


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2026-07-12 10:15:00Z", None),
        ("2026-07-12T10:15:00,123", None),
        ("2026-07-12T10:15:00+02:00", datetime(2026, 7, 12, 8, 15)),
        ("2026-07-12T10:15:00-02:30", datetime(2026, 7, 12, 12, 45)),
        ("2026-07-12T10:15:00.5Z", datetime(2026, 7, 12, 10, 15, 0, 500000)),
        ("2026-07-12 10:15:00,123", datetime(2026, 7, 12, 10, 15, 0, 123000)),
        ("2026-07-12 10:15:00.123456", datetime(2026, 7, 12, 10, 15, 0, 123456)),
        ("2026-07-12T10:15:00", datetime(2026, 7, 12, 10, 15)),
        ("2026-13-12T10:15:00", None),
    ],
)
def test_log_datetime(spark, text, expected):
    assert one(spark, text, logfields.parse_log_datetime) == expected


def test_zone_of_log_datetime(spark):
    value = one(spark, "2026-07-12T10:15:00Z", lambda c: logfields.parse_log_datetime(c, "Europe/Dublin"))
    assert value == datetime(2026, 7, 12, 11, 15)


@pytest.mark.parametrize(
    "raw, status, expected",
    [
        ("read timeout", None, "TIMEOUT"),
        ("denied", 401, "AUTHENTICATION_FAILURE"),
        ("Invalid Login", None, "AUTHENTICATION_FAILURE"),
        ("payment was blocked", None, "PAYMENT_BLOCKED"),
        ("x", 503, "SERVER_ERROR"),
        ("x", 404, "CLIENT_ERROR"),
        ("x", None, "APPLICATION_FAILURE"),
        ("failure=odd-type x", 503, "ODD_TYPE"),
    ],
)
def test_classification(spark, raw, status, expected):
    assert parse(spark, raw, status=status).failure_type == expected


def test_messages_and_status(spark):
    assert parse(spark, "a - b - c").error_message == "b - c"
    assert parse(spark, "x status_code=500").status_code is None
    assert parse(spark, "x STATUS=5001").status_code is None
    assert parse(spark, "message=one\rtwo\nthree").error_message == "one\rtwo"
    assert parse(spark, "  all  ").error_message == "all"
    assert parse(spark, "ZeroError at x message: deep").error_message == "deep"
    assert parse(spark, "éERROR").log_level is None


def test_sample_alert(spark):
    raw = "2026-07-07T10:30:00 ERROR service=payment-service status=503 x"
    document = {
        "source": "manual-test",
        "alerts": [
            {
                "status": "firing", "startsAt": "2026-07-07T10:30:00Z",
                "labels": {"alertname": "ManualIncidentTest", "service_name": "payment-service", "severity": "critical"},
                "annotations": {
                    "rawLog": raw, "traceId": "manual-payment-trace", "statusCode": "503",
                    "failureType": "PAYMENT_GATEWAY_DOWN", "description": "Payment gateway timeout",
                },
            },
            {"labels": {"alertname": "Second"}},
        ],
    }
    (row,) = normalize(spark, document)
    assert (row.alert_name, row.service_name, row.severity, row.status) == (
        "ManualIncidentTest", "payment-service", "critical", "OPEN",
    )
    assert (row.source, row.status_code, row.failure_type) == ("manual-test", 503, "PAYMENT_GATEWAY_DOWN")
    assert row.created_at == datetime(2026, 7, 7, 10, 30) and row.raw_log == raw
    assert [r.alert_name for r in normalize(spark, document, mode="all")] == ["ManualIncidentTest", "Second"]


def test_empty_alert(spark):
    (row,) = normalize(spark, "{}")
    assert (row.alert_name, row.service_name, row.severity) == ("PlatformIncident", "unknown-service", "warning")
    assert (row.raw_status, row.status, row.source) == ("firing", "OPEN", "grafana-webhook")
    assert row.trace_id == "incident-platformincident" and row.failure_type == "APPLICATION_FAILURE"
    assert row.error_message == "PlatformIncident detected"
    assert row.raw_log == (
        "2026-07-20T00:00:00 WARN service=unknown-service traceId=incident-platformincident status=500 "
        "failure=APPLICATION_FAILURE java.lang.IllegalStateException: PlatformIncident detected"
    )


def test_search_alert_and_odd_values(spark):
    rows = normalize(
        spark,
        {"search_name": "My Alert", "result": {"level": "ERROR"}},
        {"startsAt": "2026-07-12T10:15:00+02:00", "statusCode": 503.0},
        {"statusCode": " 503 ", "errorMessage": {"nested": 1}, "rawLog": '{"text": "kept"}', "severity": True},
        {"statusCode": "abc", "alerts": [], "result": "text", "startsAt": "2026-07-12 10:15:00"},
        "not json",
    )
    assert (rows[0].source, rows[0].severity, rows[0].status, rows[0].trace_id) == (
        "splunk", "critical", "OPEN", "incident-my-alert",
    )
    assert rows[1].created_at == datetime(2026, 7, 12, 10, 15) and rows[1].status_code is None
    assert rows[2].status_code == 503 and rows[2].error_message == "PlatformIncident detected"
    assert rows[2].raw_log == '{"text": "kept"}' and rows[2].severity == "true"
    assert rows[3].status_code is None and rows[3].created_at == datetime(2026, 7, 12, 10, 15)
    # A document that is no JSON object is rejected, not turned into an incident.
    assert len(rows) == 4


def test_small_alert_rules(spark):
    assert one(spark, "x" * 181, alertfields.summarize_text) == "x" * 180 + "..."
    assert one(spark, " ", alertfields.summarize_text) == "No details returned"
    assert one(spark, "--", lambda c: alertfields.incident_number(c, F.lit(1))).startswith("INC-")
    assert len(one(spark, "transaction-service", alertfields.incident_number)) == len("TRANSACT-") + 8


def test_phrases_are_whole_tokens(spark):
    def hit(text, words):
        return one(spark, text, lambda c: has_phrase(c, words))

    assert hit("Exception while processing", "Exception") and hit("an EXCEPTION: x", "Exception")
    assert not hit("java.lang.NullPointerException", "Exception")
    assert not hit("java.lang.Exception x", "Exception")
    assert hit("Connection refused while", "Connection refused") and not hit("Connection was refused", "Connection refused")
    assert not hit("PAYMENT_TIMEOUTS", "PAYMENT_TIMEOUT")


def test_each_alert_of_a_document_is_one_incident(spark):
    text = '{"alerts": [{"labels": {"alertname": "A"}}, {"labels": {"alertname": "B"}}]}'
    df = spark.createDataFrame([(7, text), (8, "{broken"), (9, None), (10, "[1]")], "payload_id long, payload string")
    rows = alerts.normalize_alerts(df, "2026-01-01 00:00:00", mode="all")
    incidents = alerts.build_incidents(rows)
    done = alerts.apply_parse_outcome(incidents, parsing.parse_logs(alerts.parse_requests(rows)), "2026-01-01 00:00:00").collect()
    assert sorted(r.alert_name for r in done) == ["A", "B"] and len({r.id for r in done}) == 2 and min(r.id for r in done if r.alert_name == "A") == 7
    assert {r.payload_id: r.reject_reason for r in alerts.rejected(df).collect()} == {8: "not a JSON object", 9: "empty document", 10: "not a JSON object"}


def test_incidents_that_carry_their_log_need_no_join(spark):
    made = [(1, '{"alertName":"A","serviceName":"pay-é x","errorMessage":"e"}'), (2, '{"alertName":" ","search_name":"S","traceId":{"a":1},"sid":"s"}')]
    rows = alerts.normalize_alerts(spark.createDataFrame(made, "payload_id long, payload string"), "2026-07-20 00:00:00")
    as_of = "2026-07-21 00:00:00"
    joined = alerts.apply_parse_outcome(alerts.build_incidents(rows), parsing.parse_logs(alerts.parse_requests(rows)), as_of)
    carried = parsing.parse_logs(alerts.parse_requests(rows, incident=F.struct(*alerts.incident_columns())))
    found = alerts.parsed_incidents(carried, as_of)
    assert found.dtypes == joined.dtypes and sorted(map(str, found.collect())) == sorted(map(str, joined.collect()))
    assert {r.id: (r.alert_name, r.trace_id, r.incident_number[:5]) for r in found.collect()} == {
        1: ("A", "incident-a", "PAYX-"), 2: ("S", "s", "UNKNO")}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_failure_names_that_are_clean_skip_the_pattern(spark):
    names = ["ok", "A_b", "__x__", "a__b", " pay-ment  down ", "ß x", "_", "-", "x.", "9", "é"]
    clean = lambda name: re.sub("[^A-Za-z0-9]+", "_", name.strip().upper()).strip("_") or "APPLICATION_FAILURE"
    found = spark.createDataFrame([(n,) for n in names], "n string").select("n", logfields.normalize_failure_type(F.col("n")).alias("f"))
    assert {r.n: r.f for r in found.collect()} == {n: clean(n) for n in names}
    assert "CASE WHEN" in str(logfields.cleaned_name(F.col("n"))._jc.toString()).upper()
