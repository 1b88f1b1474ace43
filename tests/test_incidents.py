"""Incident life cycle, dashboards, joins and keyed tables."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from faultline import schemas
from faultline.functions import display
from faultline.operators import incidents as I
from faultline.operators import keyed
from faultline.operators.numbering import number_rows

AS_OF = "2026-07-20 00:00:00"
START = datetime(2026, 1, 1)


def incident(key, **values):
    names = [field.split()[0] for field in schemas.INCIDENT.split(", ")]
    return tuple(values.get(name, key if name == "id" else None) for name in names)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.INCIDENT)


def replay(state, updates):
    """One update after the other, as a service would take them."""
    status, resolved_at, notes = state
    for at, given, new_notes, resolve in updates:
        given = (given or "").strip().upper() or None
        if given is not None and given not in ("OPEN", "ACKNOWLEDGED", "RESOLVED", "FAILED"):
            continue
        if new_notes is not None:
            notes = new_notes.strip() or None
        status = given or status
        closed = (status or "").upper() in ("RESOLVED", "CLOSED")
        if resolve:
            status = status if closed else "RESOLVED"
            resolved_at = at
        elif closed:
            resolved_at = resolved_at or at
        elif resolve is not None or given is not None:
            resolved_at = None
    return status, resolved_at, notes


def test_updates_match_a_replay(spark):
    random.seed(5)
    rows, feed, expected = [], [], {}
    for key in range(400):
        state = (random.choice(["OPEN", "RESOLVED", "CLOSED", None]), random.choice([None, START]), random.choice([None, "old"]))
        rows.append(incident(key, status=state[0], resolved_at=state[1], notes=state[2], created_at=START))
        updates = [
            (
                START + timedelta(minutes=step),
                random.choice([None, None, "", "open", "RESOLVED", " resolved ", "FAILED", "bad"]),
                random.choice([None, None, " note ", "  "]),
                random.choice([None, None, True, False]),
            )
            for step in range(random.randint(0, 6))
        ]
        feed += [(key, at, step, given, notes, done) for step, (at, given, notes, done) in enumerate(updates)]
        expected[key] = replay(state, updates)
    random.shuffle(feed)
    result = I.apply_incident_updates(table(spark, *rows), spark.createDataFrame(feed, schemas.INCIDENT_UPDATE))
    assert {r.id: (r.status, r.resolved_at, r.notes) for r in result.collect()} == expected


def test_dashboards(spark):
    rows = table(
        spark,
        incident(1, service_name=None, status="OPEN"),
        incident(2, service_name="Unknown", status=None),
        incident(3, service_name="Unknown", status="OPEN", severity="ERROR"),
    )
    assert sorted(tuple(r) for r in I.incidents_by_service(rows).collect()) == [("Unknown", 1), ("Unknown", 2)]
    assert I.mttr_minutes_7d(rows, AS_OF).first()[0] == 0
    assert I.active_incidents(rows).first()[0] == 2 and I.active_critical(rows).first()[0] == 1


def test_display_rules(spark):
    row = spark.sql("select 42L as id, cast(null as string) as n, timestamp_ntz '2026-07-12 23:30:00' as ts").select(
        display.display_incident_number(F.col("n"), F.col("id")),
        display.display_incident_number(F.col("n"), F.lit(1234567)),
        display.local_day(F.col("ts")),
        display.threshold_band(F.lit(15), [(None, "green"), (15, "yellow"), (45, "red")]),
        display.state_rank(F.lit("OPEN")),
        display.state_rank(F.lit("OPEN"), True),
    ).first()
    assert tuple(row) == ("INC-00042", "INC-1234567", "2026-07-13", "yellow", None, 2)


def test_orders_and_search(spark):
    rows = table(
        spark,
        incident(1, created_at=START, alert_name="Login"),
        incident(2, created_at=None, notes="x"),
        incident(3, created_at=START, service_name="Pay"),
    )
    assert [r.id for r in I.incidents_newest_first(rows).collect()][0] == 2
    assert [r.id for r in I.incidents_ui_order(rows).collect()] == [3, 1, 2]
    assert [r.id for r in I.search_incidents(rows, "login  ").collect()] == [1]
    assert I.has_signal(table(spark, incident(1), incident(2, notes=" "), incident(3, notes="n"))).count() == 1


def test_parsed_logs_stay_optional(spark):
    logs = spark.createDataFrame([(7, 1, "s")], "id bigint, incident_id bigint, service_name string")
    rows = I.incidents_with_parsed_logs(table(spark, incident(1), incident(2)), logs).orderBy("id").collect()
    assert rows[0].parsed_log.service_name == "s" and rows[1].parsed_log is None


def test_upsert_keeps_identity_and_is_repeatable(spark):
    target = spark.createDataFrame(
        [(5, 1, "a", START, START), (6, 2, "b", START, START)],
        "id bigint, incident_id bigint, reason string, created_at timestamp_ntz, updated_at timestamp_ntz",
    )
    feed = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (9, 1, "new"), (4, 1, "n4")], "incident_id bigint, seq int, reason string")
    once = keyed.upsert_by_key(target, feed, "incident_id", ["seq"], AS_OF)
    twice = keyed.upsert_by_key(once, feed, "incident_id", ["seq"], AS_OF)
    rows = {r.incident_id: r for r in twice.collect()}
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert (rows[1].id, rows[1].reason, rows[1].created_at) == (5, "y", START)
    assert (rows[2].reason, rows[2].updated_at) == ("b", START)
    assert (rows[4].id, rows[9].id) == (7, 8)


def test_numbering_follows_the_order_over_ranges(spark):
    rows = spark.range(2000).select(F.xxhash64("id").alias("key"), (F.col("id") % 3).alias("third"))
    numbered = number_rows(rows, [F.desc("third"), F.col("key")], "n", rows_per_range=150)
    found = sorted((r.n, -r.third, r.key) for r in numbered.collect())
    assert [n for n, _, _ in found] == list(range(1, 2001)) and found == sorted(found, key=lambda r: r[1:])
    assert number_rows(rows.limit(0), [F.col("key")]).count() == 0


def test_a_key_of_all_rows_is_numbered_in_ranges(spark):
    numbered = number_rows(spark.range(900).select(F.lit(7).alias("key")), [F.col("key")], "n", rows_per_range=100)
    assert sorted(r.n for r in numbered.collect()) == list(range(1, 901))


def test_random_keys_are_numbered_without_one_task(spark):
    target = spark.createDataFrame([(5, 1, "a", START, START)], "id bigint, key bigint, reason string, created_at timestamp_ntz, updated_at timestamp_ntz")
    feed = spark.range(2000).select(F.xxhash64("id").alias("key"), F.lit(1).alias("seq"), F.lit("x").alias("reason"))
    plan = keyed.upsert_by_key(target, feed, "key", ["seq"], AS_OF, top=5)
    assert "SinglePartition" not in plan._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in plan.collect()) == list(range(5, 2006))


def test_updates_are_reduced_once(spark):
    target = spark.createDataFrame([(5, 1, "a", START, START)], "id bigint, key bigint, reason string, created_at timestamp_ntz, updated_at timestamp_ntz")
    feed = spark.range(77).select(F.col("id").alias("key"), F.lit(1).alias("seq"), F.lit("x").alias("reason"))
    merged = keyed.upsert_by_key(target, feed, "key", ["seq"], AS_OF)
    assert "Range (0, 77" not in merged._jdf.queryExecution().executedPlan().toString()
    assert merged.count() == 77


def test_newest_rows_need_no_sort_aggregate(spark):
    rows = [("a", START, 1, "x"), ("a", START, 2, "y"), ("a", None, 9, "z"), ("b", START, None, "p"), ("b", START, None, "p"), (None, START, -5, "n")]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, seq bigint, note string")
    newest = keyed.latest_per_key(df, ["key"], ["ts", "seq"])
    assert sorted((r.key or "", r.note) for r in newest.collect()) == [("", "n"), ("a", "y"), ("b", "p")]
    assert "SortAggregate" not in newest._jdf.queryExecution().executedPlan().toString()
    edge = [("k", START, 2**63 - 1, "top"), ("k", START, -(2**63), "low"), ("m", START, -1, "low"), ("m", START, 0, "top")]
    found = keyed.latest_per_key(spark.createDataFrame(edge, df.schema), ["key"], ["ts", "seq"]).collect()
    assert [r.note for r in found] == ["top", "top"]


def test_fallback_and_vector_or(spark):
    first = spark.createDataFrame([(1, 1.0)], "job int, value double")
    second = spark.createDataFrame([(1, 9.0), (2, 2.0)], "job int, value double")
    assert sorted(map(tuple, keyed.vector_or(first, second, ["job"]).collect())) == [(1, 1.0), (2, 2.0)]
    assert keyed.read_with_fallback(first, second, "job", "when_empty").count() == 1
    assert keyed.read_with_fallback(first.limit(0), second, "job", "when_empty").count() == 2


def test_vector_or_keeps_repeated_label_sets(spark):
    first = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 3.0), (None, 4.0)], "job int, value double")
    second = spark.createDataFrame([(1, 9.0), (2, 2.0), (2, 2.0), (None, 5.0)], "job int, value double")
    found = [tuple(row) for row in keyed.vector_or(first, second, ["job"]).collect()]
    assert sorted(found, key=str) == [(1, 1.0), (1, 1.0), (1, 3.0), (2, 2.0), (2, 2.0), (None, 4.0), (None, 5.0)]
