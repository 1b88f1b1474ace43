"""Keyed tables in buckets under one manifest, and the jobs that keep them."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faultline.operators import rules
from faultline.session import scratch
from faultline.sources import files, store
from faultline.streaming import jobs, stateful

AS_OF, LATER = "2026-07-20 00:00:00", "2026-07-21 00:00:00"
SCHEMA = "id bigint, key bigint, note string, created_at timestamp_ntz, updated_at timestamp_ntz"
START = datetime(2026, 1, 1)


def rows(spark, *values):
    return spark.createDataFrame([(k, s, n) for k, s, n in values], "key int, seq int, note string")


@pytest.fixture
def path(spark):
    place = scratch(spark, "store")
    store.create(spark, place, {"a": (SCHEMA, "key"), "b": (SCHEMA, "key")}, buckets=8)
    return place


def content(spark, path, name, version=None):
    return {r.key: (r.id, r.note) for r in store.read(spark, path, name, version).collect()}


def test_a_batch_rewrites_touched_buckets_only(spark, path):
    store.commit(spark, path, {"a": (rows(spark, *[(k, 1, f"n{k}") for k in range(50)]), ["seq"])}, "feed", 0, AS_OF)
    before = store.manifest(spark, path)
    assert content(spark, path, "a") == {k: (k + 1, f"n{k}") for k in range(50)} and before["tables"]["a"]["top"] == 50
    store.commit(spark, path, {"a": (rows(spark, (7, 2, "new"), (7, 1, "old"), (99, 1, "more"), (None, 1, "no key")), ["seq"])}, "feed", 1, LATER)
    after = store.manifest(spark, path)
    changed = {b for b, place in after["tables"]["a"]["files"].items() if before["tables"]["a"]["files"].get(b) != place}
    assert 1 <= len(changed) <= 2 and len(before["tables"]["a"]["files"]) > 4
    found = content(spark, path, "a")
    assert found[7] == (8, "new") and found[99] == (51, "more") and found[8] == (9, "n8") and len(found) == 51
    row = store.read(spark, path, "a").where("key = 7").first()
    assert (str(row.created_at), str(row.updated_at)) == (AS_OF, LATER)
    # Readers of the older version are not disturbed.
    assert content(spark, path, "a", before["version"])[7] == (8, "n7")


def test_a_repeated_batch_changes_nothing(spark, path):
    for source, batch in (("one", 0), ("two", 0), ("one", 1)):
        store.commit(spark, path, {"a": (rows(spark, (1, 1, f"{source}{batch}")), ["seq"])}, source, batch, AS_OF)
    state = store.manifest(spark, path)
    again = store.commit(spark, path, {"a": (rows(spark, (1, 1, "again")), ["seq"])}, "one", 1, AS_OF)
    assert again == state["version"] and store.manifest(spark, path) == state
    assert content(spark, path, "a") == {1: (1, "one1")} and state["applied"] == {"one": 1, "two": 0}


def test_tables_change_together_and_the_second_writer_fails(spark, path):
    version = store.commit(spark, path, {"a": (rows(spark, (1, 1, "x")), ["seq"]), "b": (rows(spark, (1, 1, "y")), ["seq"])}, "feed", 0)
    assert version == 1 and store.versions(spark, path) == [0, 1]
    assert content(spark, path, "a", 0) == {} and content(spark, path, "b") == {1: (1, "y")}
    late = store.manifest(spark, path, 0) | {"version": 1}
    with pytest.raises(Exception, match="[Ee]xist"):
        store._commit(spark, path, late)
    # A manifest that is still being written is passed over.
    files.write_new(spark, f"{path}/{store.MANIFESTS}/{2:012d}.json", '{"version": 2, "tab')
    assert store.manifest(spark, path)["version"] == 1


def test_vacuum_keeps_what_kept_versions_name(spark, path):
    for batch in range(4):
        store.commit(spark, path, {"a": (rows(spark, *[(k, 1, f"{batch}") for k in range(20)]), ["seq"])}, "feed", batch, AS_OF)
    want = content(spark, path, "a")
    assert store.vacuum(spark, path, keep=1) > 0 and store.vacuum(spark, path, keep=1) == 0
    assert content(spark, path, "a") == want and store.versions(spark, path) == [4]


def test_empty_changes(spark, path):
    assert store.commit(spark, path, {"a": (rows(spark).where("false"), ["seq"])}, "feed", 0) == 1
    assert content(spark, path, "a") == {}


def samples(spark, values):
    made = [(START.replace(minute=s // 60, second=s % 60), "up", {"job": "payment-service"}, float(v)) for s, v in values]
    return spark.createDataFrame(made, "ts timestamp_ntz, metric string, labels map<string,string>, value double")


def test_outages_of_any_order_equal_the_batch_rule(spark):
    values = [(s, 0 if 30 <= s < 200 or 300 <= s < 320 or 400 <= s else 1) for s in range(0, 600, 5)]
    slices = [values[:50], values[60:90], values[50:60] + values[90:]]  # the middle comes late
    path = scratch(spark, "samples")
    for part in slices:
        samples(spark, part).coalesce(1).write.mode("append").parquet(path)
    last = samples(spark, [(599, 1)]).withColumn("ts", F.col("ts") + F.expr("interval '2' day"))
    last.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(last.schema).option("maxFilesPerTrigger", 1).parquet(path)
    found = jobs.run_available(stateful.service_down_alerts(stream, 30.0), "outages")
    want = rules.service_down_alerts(samples(spark, values), 30.0)
    assert sorted(map(str, found.where("status = 'resolved'").drop("status").collect())) == sorted(map(str, want.collect()))
    assert found.where("status = 'firing'").count() == want.count() == 2


def test_one_late_row_counts_as_one(spark):
    path = scratch(spark, "logs")
    # Late is what comes behind the watermark that the batch before had.
    for day, times in ((10, 3), (11, 1), (1, 1)):
        made = [(START.replace(day=day, hour=h), "ERROR", f"e{day}{h}", "m") for h in range(times)]
        spark.createDataFrame(made, "ts timestamp_ntz, level string, event_id string, message string").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("ts timestamp_ntz, level string, event_id string, message string").option("maxFilesPerTrigger", 1).parquet(path)
    with jobs.late_rows(spark) as counted:
        hits = jobs.run_available(jobs.first_hits(stream, "event_id"), "late")
        assert {r.job: r.dropped for r in counted.table(spark).collect()} == {"late": 1}
    assert hits.count() == 4


@pytest.mark.parametrize(("pending", "quiet", "every"), [(30.0, 86400.0, 7), (200.0, 400.0, 50), (45.0, 90.0, 1), (1.0, 20.0, 3)])
def test_outages_at_random_equal_the_plain_walk(spark, pending, quiet, every):
    random.seed(int(pending + every))
    values, at, state = [], 0, 1
    for _ in range(600):
        at += random.choice([1, every, every, 3 * every, 300 if random.random() < 0.05 else every])
        state = 1 - state if random.random() < 0.15 else state
        values.append((at, state))
    made = [(START + timedelta(seconds=s), "up", {"job": "payment-service"}, float(v)) for s, v in values]
    layout = "ts timestamp_ntz, metric string, labels map<string,string>, value double"
    path = scratch(spark, "samples")
    for part in (made[:150], made[250:400], made[150:250] + made[400:]):
        spark.createDataFrame(part, layout).repartition(1).write.mode("append").parquet(path)
    spark.createDataFrame([(made[-1][0] + timedelta(days=10), *made[0][1:3], 1.0)], layout).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(layout).option("maxFilesPerTrigger", 1).parquet(path)
    alerts = stateful.service_down_alerts(stream, pending, quiet, "3 days")
    found = jobs.run_available(alerts, "outages").collect()
    want, run = [], []
    for s, v in [*values, (at + 864000, 1)]:
        if run and (v or s - run[-1] > quiet):
            want += [(run[0], run[-1], len(run))] if run[-1] - run[0] >= pending else []
            run = []
        run += [] if v else [s]
    seconds = lambda t: round((t - START).total_seconds())
    assert want and sorted((seconds(r.down_from), seconds(r.down_to), r.samples) for r in found if r.status == "resolved") == want
    assert sorted(seconds(r.down_from) for r in found if r.status == "firing") == [w[0] for w in want]


def test_a_window_of_many_samples_is_few_rows_for_the_state(spark):
    many = [(START + timedelta(milliseconds=20 * i), i // 250 % 2 == 1) for i in range(3000)]
    rows = spark.createDataFrame(many, "ts timestamp_ntz, down boolean").selectExpr("unix_micros(cast(ts as timestamp)) as at", "down")
    window = rows.agg(F.sort_array(F.collect_list(F.struct("at", "down"))).alias("samples"))
    found = window.select(F.inline(stateful.down_stretches("samples", 30.0, 60.0))).collect()
    # 60 seconds of 50 samples a second, down for five seconds at a time: only the last stretch, which is still open, can fire.
    first = round((START - datetime(1970, 1, 1)).total_seconds() * 1e6)
    assert [(r.at - first, r["last"] - first, r.n, r.fresh, r.closed) for r in found] == [(55_000_000, 59_980_000, 250, 1, 0)]


def test_unique_updates_meet_their_bucket_in_one_shuffle(spark):
    path = scratch(spark, "store")
    schema = "key bigint, note string, kept string, created_at timestamp_ntz, updated_at timestamp_ntz"
    store.create(spark, path, {"a": (schema, "key")}, buckets=4)
    first = spark.createDataFrame([(k, f"n{k}", f"k{k}") for k in range(20)], "key int, note string, kept string")
    store.commit(spark, path, {"a": (first, None)}, "feed", 0, AS_OF)
    some = spark.createDataFrame([(3, "new"), (77, None), (None, "no key")], "key int, note string")
    store.commit(spark, path, {"a": (some, None)}, "feed", 1, LATER)
    found = {r.key: (r.note, r.kept, str(r.created_at), str(r.updated_at)) for r in store.read(spark, path, "a").collect()}
    want = {k: (f"n{k}", f"k{k}", AS_OF, AS_OF) for k in range(20)}
    assert found == want | {3: ("new", "k3", AS_OF, LATER), 77: (None, None, LATER, LATER)}
    rows, bucket = store.read(spark, path, "a"), store.bucket_of(F.col("key"), 4)
    merged = store._merged(rows.withColumn(store.BUCKET, bucket), rows.withColumn(store.BUCKET, bucket), "key", F.col("key") % 4, LATER)
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
