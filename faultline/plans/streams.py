"""Queries that run an operator as a stream over files and give the same rows as its batch form."""

from pyspark.sql import functions as F

from faultline import constants as C
from faultline.operators import alerts, features, forest, parsing, rules
from faultline.plans import adapters as A
from faultline.plans import metrics as M
from faultline.plans import models as M2
from faultline.plans.logs import LOG_COLUMNS, logs
from faultline.plans.registry import MAPPINGS, query
from faultline.session import scratch, stage
from faultline.sources import logs as sources
from faultline.sources import store
from faultline.streaming import jobs, stateful



PARTS = 4


def parts_of(spark):
    """Files of one trigger: as many as cores, so that a trigger of any size is read by all of them."""
    return max(PARTS, spark.sparkContext.defaultParallelism)


def as_stream(df, name, triggers=None):
    """Write rows as files and read them back as a stream: in one trigger, or in several of as many files as cores."""
    spark = df.sparkSession
    path, parts = scratch(spark, name), parts_of(spark)
    (df if triggers is None else df.repartition(triggers * parts)).write.parquet(path)
    reader = spark.readStream.schema(df.schema)
    return (reader if triggers is None else reader.option("maxFilesPerTrigger", parts)).parquet(path)


def write_shuffled(df, name, time="ts", slices=4, late=120, by=()):
    """Write rows as slices of files in order of time; gives the folder.

    Those near a border come in either slice, up to `late` seconds late, as their time and the columns `by` decide. A
    far-later row at the end lets the watermark pass all real ones. Each slice has `parts_of` files, so a trigger of that many
    files reads one slice by all cores.
    """
    spark = df.sparkSession
    path, seconds = scratch(spark, name), F.unix_seconds(F.col(time).cast("timestamp"))
    stored = stage(df, name)
    cuts = stored.agg(F.percentile_approx(seconds, [i / slices for i in range(1, slices)], 10_000)).first()[0] or []
    moved = seconds + F.pmod(F.xxhash64(F.col(time), *by), F.lit(late))
    number = sum([(moved > cut).cast("int") for cut in cuts], F.lit(0))
    for i in range(slices):
        stored.filter(number == i).drop(*by).repartition(parts_of(spark)).write.mode("append").parquet(path)
    far_later(stored.drop(*by), time).coalesce(1).write.mode("append").parquet(path)
    return path


def slices_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", parts_of(spark)).parquet(path)


def shuffled_stream(df, name, time="ts", **options):
    """Rows as a stream over four triggers, out of order between them."""
    return slices_of(df.sparkSession, write_shuffled(df, name, time, **options), df.schema)


def far_later(df, time="ts"):
    """The newest row 400 days later, so that the watermark passes all real ones; every task gives one candidate."""
    last = df.orderBy(F.col(time).desc()).limit(1)
    return last.withColumn(time, F.col(time) + F.expr("interval '400' day"))


@query("select incident_id, service_name, failure_type, status_code, log_timestamp from {parsed}")
def stream_parse_logs(spark, folder):
    stream = as_stream(A.mapped(spark, folder, A.PARSE_REQUESTS, heavy=True), "requests", triggers=4)
    parsed = jobs.run_available(parsing.parse_logs(stream), "parsed")
    return parsed.select("incident_id", "service_name", "failure_type", "status_code", "log_timestamp")


@query("select payload_id, alert_name, service_name, severity, status, created_at from {normalized}")
def stream_normalize_alerts(spark, folder):
    stream = as_stream(A.mapped(spark, folder, A.ALERT_PAYLOADS, heavy=True), "payloads", triggers=4)
    rows = jobs.run_available(alerts.normalize_alerts(stream, A.EVENT_AS_OF), "alerts")
    return rows.select("payload_id", "alert_name", "service_name", "severity", "status", "created_at")


@query("select * from {rule_runs}")
def stream_log_pattern_alerts(spark, folder):
    end = f"timestamp_ntz '{A.EVENT_AS_OF}' + interval '1' day"
    stream = shuffled_stream(logs(spark, folder), "logs")
    found = jobs.run_available(jobs.log_pattern_alerts(stream), "pattern-alerts")
    return found.filter(f"run_at < {end}")


@query("""
select time_bucket(interval '1 minute', ts) + interval '1 minute' as run_at, service_name as "serviceName", message as "errorMessage" from {login_events}
""")
def stream_login_failure_alerts(spark, folder):
    end = f"timestamp_ntz '{A.EVENT_AS_OF}' + interval '1' day"
    found = logs(spark, folder).filter(F.contains(F.lower("message"), F.lit(C.LOGIN_PHRASE.lower())))
    stream = shuffled_stream(found, "logs")
    rows = jobs.run_available(jobs.login_failure_alerts(stream), "login-alerts")
    return rows.filter(f"run_at < {end}").select("run_at", "serviceName", "errorMessage")


@query("""
select 'resolved' as status, * from {down_alerts}
union all
select 'firing', alertname, job, down_from, null, null, fired_at, summary, description from {down_alerts}
""")
def stream_service_down_alerts(spark, folder):
    """The batch rule's own SQL, over four triggers out of order; an outage fires once and is resolved once."""
    stream = shuffled_stream(M.samples(spark, folder, "up"), "samples")
    return jobs.run_available(stateful.service_down_alerts(stream, 1800.0, quiet=100 * 86400.0), "down-alerts")


@query("select eval_ts, 'firing' as status, value, 'PaymentServiceBlockedPayments' as alertname from {blocked_alerts}")
def stream_blocked_payment_alerts(spark, folder):
    """The batch rule's own SQL, over four triggers with samples out of order between them."""
    end = f"timestamp_ntz '{A.EVENT_AS_OF}' + interval '1' day"
    rows = M.samples(spark, folder, C.HTTP_COUNT)
    own = rows.filter((F.col("labels")["job"] == "payment-service") & (F.col("labels")["status"] == "400"))
    stream = shuffled_stream(own, "samples")
    found = jobs.run_available(stateful.blocked_payment_alerts(stream, M.WINDOW, M.STEP), "blocked-alerts")
    return found.select("eval_ts", "status", "value", F.col("labels")["alertname"].alias("alertname")).filter(f"eval_ts < {end}")


@query("""
select rule, 'active' as state, run_at as changed_at from {rule_runs} r where not exists (select 1 from {rule_runs} o where o.rule = r.rule and o.run_at = r.run_at - interval '1 minute')
union all
select rule, 'inactive', run_at + interval '1 minute' from {rule_runs} r where not exists (select 1 from {rule_runs} o where o.rule = r.rule and o.run_at = r.run_at + interval '1 minute')
""")
def stream_on_state_change(spark, folder):
    end = f"timestamp_ntz '{A.EVENT_AS_OF}' + interval '1' day"
    runs = rules.log_pattern_alerts(logs(spark, folder)).select("rule", "run_at")
    stream = shuffled_stream(runs, "runs", "run_at")
    return jobs.run_available(stateful.on_state_change(stream, 60.0), "state-changes").filter(f"changed_at < {end}")


@query("select rule as \"group\", sent_at, kind, new_alerts from {notifications}")
def stream_group_notifications(spark, folder):
    end = f"timestamp_ntz '{A.EVENT_AS_OF}' + interval '1' day"
    hits = rules.log_rule_hits(logs(spark, folder)).select("rule", "ts")
    sent = stateful.group_notifications(shuffled_stream(hits, "hits"), "rule", 600.0, 1800.0, 7200.0, 3600.0)
    return jobs.run_available(sent, "notifications").filter(f"sent_at < {end}")


@query("select event_id, rule, ts from {rule_hits}")
def stream_first_hits(spark, folder):
    """Rule hits of a source that delivers every log twice, the second time in another place."""
    end = f"timestamp_ntz '{A.EVENT_AS_OF}' + interval '1' day"
    twice = logs(spark, folder).withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1))))
    own = logs(spark, folder).schema
    stream = slices_of(spark, write_shuffled(twice, "logs", by=["_copy"]), own)
    found = jobs.run_available(jobs.first_hits(stream, "event_id"), "first-hits")
    return found.filter(f"ts < {end}").select("event_id", "rule", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("""
select 'late-hits' as job, count(*) as dropped from {rule_hits} where date_trunc('day', ts) = (select date_trunc('day', min(ts)) from {logs})
union all select 'hits', 0
""")
def stream_late_rows(spark, folder):
    """Rows behind the watermark, counted per job: the first day's logs come once more when all is over."""
    rows = logs(spark, folder)
    first = rows.agg(F.date_trunc("day", F.min("ts"))).scalar()
    with jobs.late_rows(spark) as counted:
        jobs.run_available(jobs.first_hits(shuffled_stream(rows, "logs"), "event_id"), "hits")
        path = write_shuffled(rows, "logs")
        rows.filter(F.date_trunc("day", "ts") == first).repartition(parts_of(spark)).write.mode("append").parquet(path)
        jobs.run_available(jobs.first_hits(slices_of(spark, path, rows.schema), "event_id"), "late-hits")
        return counted.table(spark)


@query("""
select strftime(ts, '%Y.%m.%d') as event_day, count(*) as logs, count(*) filter (where level = 'ERROR') as errors from {logs} group by 1
""")
def stream_ingest_logs(spark, folder):
    table, lines, progress = (scratch(spark, name) for name in ("table", "lines", "progress"))
    stream = as_stream(logs(spark, folder).select(*LOG_COLUMNS), "logs", triggers=4)
    jobs.ingest_logs(stream, table, lines, progress, A.EVENT_AS_OF).awaitTermination()
    stored = sources.read_daily_logs(spark, table, "0000.00.00", "9999.99.99")
    return stored.groupBy(F.col("event_day").cast("string").alias("event_day")).agg(
        F.count("*").alias("logs"), F.count_if(F.col("log_level") == "ERROR").alias("errors")
    )


MAPPINGS["alert_encoders"] = MAPPINGS["encoders"].replace("{parsed}", "{alert_parsed}")
MAPPINGS["alert_matrix"] = MAPPINGS["matrix"].replace("{parsed}", "{alert_parsed}").replace("{encoders}", "{alert_encoders}")
MAPPINGS["alert_scores"] = MAPPINGS["fixed_scores"].replace("{matrix}", "{alert_matrix}")
ALERT_RESULTS = f"""
select n.payload_id as id, n.alert_name, p.failure_type, p.status_code, coalesce(nullif(p.trace_id, ''), n.trace_id) as trace_id,
       s.is_anomaly, s.anomaly_score, case when not s.is_anomaly then '{C.REASON_NORMAL}'
         when m.is_error = 0 and m.status_code < 500 and m.error_msg_length <= {C.LONG_MESSAGE} then '{C.REASON_STATISTICAL}'
         else '{C.REASON_PREFIX}' || concat_ws(', ', case when m.is_error = 1 then '{C.REASON_LEVEL}' end,
           case when m.status_code >= 500 then '{C.REASON_STATUS}' || cast(cast(m.status_code as int) as string) end,
           case when m.error_msg_length > {C.LONG_MESSAGE} then '{C.REASON_LENGTH}' end) end as reason
from {{normalized}} n join {{alert_parsed}} p on p.incident_id = n.payload_id
join {{alert_matrix}} m on m.incident_id = n.payload_id join {{alert_scores}} s on s.incident_id = n.payload_id
"""
RESULT_COLUMNS = ["is_anomaly", "round(anomaly_score, 6) as anomaly_score", "reason"]


def _alert_logs(spark, folder):
    documents = A.mapped(spark, folder, A.ALERT_PAYLOADS, heavy=True)
    rows = stage(alerts.normalize_alerts(documents, A.EVENT_AS_OF), "alerts")
    return rows, stage(parsing.parse_logs(alerts.parse_requests(rows)), "parsed-logs")


@query(ALERT_RESULTS)
def alerts_to_results(spark, folder):
    """Alert documents to incidents, parsed logs and, last, anomaly results of a known forest."""
    rows, parsed = _alert_logs(spark, folder)
    encoders = stage(features.fit_encoders(parsed), "encoders")
    marked = alerts.apply_parse_outcome(alerts.build_incidents(rows), parsed, A.EVENT_AS_OF)
    results = forest.detect_anomalies(marked.select(F.col("id").alias("incident_id")), parsed, encoders, M2.fixed_model(spark))
    logs_of = parsed.select(F.col("incident_id").alias("id"), "failure_type", "status_code")
    return marked.select("id", "alert_name", "trace_id").join(logs_of, "id").join(
        results.filter("found").selectExpr("incident_id as id", *RESULT_COLUMNS), "id")


@query(ALERT_RESULTS)
def stream_alerts_to_incidents(spark, folder):
    """Every document comes twice, over four triggers; each incident has one row in each table of the last version."""
    target, progress = scratch(spark, "incident-tables"), scratch(spark, "progress")
    documents = A.mapped(spark, folder, A.ALERT_PAYLOADS, heavy=True)
    known = parsing.parse_logs(alerts.parse_requests(alerts.normalize_alerts(documents, A.EVENT_AS_OF)))
    # The classes are all that the encoders need of the logs.
    known = stage(known.select("service_name", "failure_type").distinct(), "known")
    encoders = stage(features.fit_encoders(known), "encoders")
    stream = as_stream(documents.unionByName(documents), "payloads", triggers=4)
    jobs.alerts_to_incidents(stream, target, progress, encoders, M2.fixed_model(spark), A.EVENT_AS_OF).awaitTermination()
    marked = store.read(spark, target, "incidents").select(F.col("incident_id").alias("id"), "alert_name", "trace_id")
    parsed = store.read(spark, target, "parsed_logs").select(F.col("incident_id").alias("id"), "failure_type", "status_code")
    results = store.read(spark, target, "anomaly_results").selectExpr("incident_id as id", *RESULT_COLUMNS)
    return marked.join(parsed, "id").join(results, "id")


@query("""
select s.incident_id, s.decision, s.is_anomaly, s.anomaly_score from {fixed_scores} s
""")
def stream_scores(spark, folder):
    """Arriving parsed logs scored by a stored forest, in several triggers."""
    rows = M2.stored_logs(spark, folder)
    encoders = stage(features.fit_encoders(rows), "encoders")
    scored = jobs.score_stream(as_stream(rows, "parsed", triggers=4), encoders, M2.fixed_model(spark))
    return jobs.run_available(scored, "scores").select(
        "incident_id", F.round("decision", 6).alias("decision"), "is_anomaly", F.round("anomaly_score", 6).alias("anomaly_score"))


@query("""
select incident_id, last_status as failure_type from (
  select incident_id, arg_max(coalesce(status, 'none'), (changed_at, seq)) as last_status from {updates} group by 1)
""")
def stream_upsert(spark, folder):
    path = scratch(spark, "upserted")
    feed = A.mapped(spark, folder, A.INCIDENT_UPDATES).select(
        "incident_id", "changed_at", "seq", F.coalesce("status", F.lit("none")).alias("failure_type")
    )
    schema = "id bigint, incident_id bigint, failure_type string, created_at timestamp_ntz, updated_at timestamp_ntz"
    stream = shuffled_stream(feed, "feed", "changed_at", late=1)
    own = scratch(spark, "progress")
    jobs.upsert_stream(stream, path, schema, "incident_id", ["changed_at", "seq"], own, A.ORDER_AS_OF).awaitTermination()
    return store.read(spark, path, "rows").select("incident_id", "failure_type")
