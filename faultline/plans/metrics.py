"""Queries over metric samples and alert rules. Windows are hours, as the samples are minutes apart."""

from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions.labels import match_labels
from faultline.operators import alerts, metrics, parsing, rules
from faultline.operators import keyed
from faultline.plans import adapters as A
from faultline.plans.logs import logs
from faultline.plans.registry import MAPPINGS, query
from faultline.session import scratch, stage
from faultline.sources import logs as sources

WINDOW, STEP = 21600.0, 3600.0
SPANS = int(WINDOW / STEP)
HTTP = C.HTTP_COUNT, C.HTTP_SUM, C.GATEWAY_COUNT, C.GATEWAY_SUM
SERIES = "job, status, uri, area, route, code"


def samples(spark, folder, *names):
    return A.metric_samples(spark, folder, *names)


def rates(spark, folder, *names):
    return metrics.Rates(samples(spark, folder, *names), WINDOW, STEP)


def _ranges(name, where="true"):
    """Checking SQL of the growth of a counter: the definition applied sample by sample."""
    return f"""
select {SERIES}, slot, sum(growth) - arg_min(growth, ts) as increase, count(*) as n, min(ts) as first_ts, max(ts) as last_ts, arg_min(value, ts) as first_value
from (select *, case when prev is null then 0 when value < prev then value else value - prev end as growth,
             unnest(range(cast(ceil(epoch_us(ts) / 1e6 / {STEP}) as bigint), cast(ceil(epoch_us(ts) / 1e6 / {STEP}) as bigint) + {SPANS})) as slot
      from (select *, lag(value) over (partition by {SERIES} order by ts) as prev from {{m_{name}}} where {where}))
group by all having count(*) >= 2
"""


def _at(step=STEP):
    return f"make_timestamp(cast(slot * {step} * 1000000 as bigint))"


def _sums(name, labels, where="true"):
    """Checking SQL of a rate summed by labels."""
    return f"select {_at()} as eval_ts, {labels}, sum(increase / {WINDOW}) as value from ({_ranges(name, where)}) group by all"


def _or(left, right, labels):
    return f"""
select * from ({left}) union all
select r.* from ({right}) r where not exists (select 1 from ({left}) l where l.eval_ts = r.eval_ts and {' and '.join(f'l.{x} = r.{x}' for x in labels)})
"""


def rounded(df):
    return df.withColumn("value", F.round("value", 6))


def _rounded(sql, columns):
    return f"select eval_ts, {columns}, round(value, 6) as value from ({sql})"


JOBS = "job in ('user-service', 'transaction-service', 'payment-service')"
ERRORS = "regexp_full_match({0}, '4..|5..')"


@query("select metric, job, count(*) as samples, sum(value) as total from {m_up} group by all")
def read_metric_samples(spark, folder):
    path = scratch(spark, "samples")
    samples(spark, folder, "up").write.parquet(path)
    stored = sources.read_metric_samples(spark, path)
    return stored.groupBy("metric", F.col("labels")["job"].alias("job")).agg(
        F.count("*").alias("samples"), F.sum("value").alias("total")
    )


@query(f"""
select ts, job, status from {{m_{C.HTTP_COUNT}}} where job = 'user-service' and regexp_full_match(status, '4..|5..')
""")
def match_series(spark, folder):
    rows = samples(spark, folder, C.HTTP_COUNT)
    kept = rows.filter(match_labels(F.col("labels"), {"job": "user-service"}, {"status": C.ERROR_STATUS}))
    return kept.select("ts", F.col("labels")["job"].alias("job"), F.col("labels")["status"].alias("status"))


@query("select ts, job, value from {m_up} where value = 0")
def value_compare(spark, folder):
    rows = metrics.value_compare(samples(spark, folder, "up"), "==", 0)
    return rows.select("ts", F.col("labels")["job"].alias("job"), "value")


@query("""
select job, arg_max(value, ts) as value, case arg_max(value, ts) when 0 then 'Down' else 'Up' end as state from {m_up} group by 1
""")
def availability(spark, folder):
    return metrics.availability(samples(spark, folder, "up"))


@query("select job, arg_max(value, ts) filter (where cast(floor(epoch(ts)) as bigint) % 2 = 0) as value from {m_process_cpu_usage} group by 1")
def last_not_null(spark, folder):
    """Samples of odd seconds have no value."""
    rows = samples(spark, folder, "process_cpu_usage")
    rows = rows.withColumn("value", F.when(F.unix_seconds(F.col("ts").cast("timestamp")) % 2 == 0, F.col("value")))
    return metrics.last_not_null(rows, [F.col("labels")["job"].alias("job")])


@query("select ts, job, value / 60 as value from {m_process_uptime_seconds}")
def uptime_minutes(spark, folder):
    return metrics.uptime_minutes(samples(spark, folder, "process_uptime_seconds"))


@query(f"select {_at()} as eval_ts, job, coalesce(status, '') as status, coalesce(uri, '') as uri, increase as value from ({_ranges(C.HTTP_COUNT)})")
def counter_increase(spark, folder):
    rows = metrics.counter_increase(samples(spark, folder, C.HTTP_COUNT), WINDOW, STEP)
    return rows.select("eval_ts", *[F.coalesce(F.col("labels")[n], F.lit("")).alias(n) for n in ("job", "status", "uri")], "value")


@query(f"select {_at()} as eval_ts, job, status, uri, round(increase / {WINDOW}, 6) as value from ({_ranges(C.HTTP_COUNT)})")
def counter_rate(spark, folder):
    rows = metrics.counter_rate(samples(spark, folder, C.HTTP_COUNT), WINDOW, STEP)
    return rounded(rows.select("eval_ts", *[F.col("labels")[n].alias(n) for n in ("job", "status", "uri")], "value"))


@query(f"""
with base as (select *, epoch_us(first_ts) / 1e6 as f, epoch_us(last_ts) / 1e6 as l, slot * {STEP} as e from ({_ranges(C.GATEWAY_COUNT)})),
gaps as (select *, l - f as sampled, (l - f) / (n - 1) as gap, f - (e - {WINDOW}) as head, e - l as tail from base),
edges as (select *, least(case when head >= gap * 1.1 then gap / 2 else head end,
                          case when increase > 0 and first_value >= 0 then sampled * first_value / increase else 1e18 end) as to_start,
                 case when tail >= gap * 1.1 then gap / 2 else tail end as to_end from gaps)
select {_at()} as eval_ts, route, code, round(increase * (case when sampled = 0 then 1 else (sampled + to_start + to_end) / sampled end) / {WINDOW}, 6) as value from edges
""")
def counter_rate_extrapolated(spark, folder):
    rows = metrics.counter_rate(samples(spark, folder, C.GATEWAY_COUNT), WINDOW, STEP, extrapolate=True)
    return rounded(rows.select("eval_ts", F.col("labels")["routeId"].alias("route"), F.col("labels")["httpStatusCode"].alias("code"), "value"))


THROUGHPUT = _or(_sums(C.HTTP_COUNT, "job", JOBS), _sums(C.GATEWAY_COUNT, "job"), ["job"])


@query(_rounded(THROUGHPUT, "job"))
def throughput_by_service(spark, folder):
    return rounded(rates(spark, folder, *HTTP).throughput_by_service())


@query(_rounded(_or(
    _sums(C.HTTP_COUNT, "job", JOBS + " and " + ERRORS.replace("{0}", "status")),
    _sums(C.GATEWAY_COUNT, "job", ERRORS.replace("{0}", "code")), ["job"],
), "job"))
def error_rate(spark, folder):
    return rounded(rates(spark, folder, *HTTP).error_rate())


@query(_rounded(_or(
    _sums(C.HTTP_COUNT, "job, status", JOBS),
    f"select {_at()} as eval_ts, job, code as status, sum(increase / {WINDOW}) as value from ({_ranges(C.GATEWAY_COUNT)}) group by all",
    ["job", "status"],
), "job, status"))
def requests_by_status(spark, folder):
    return rounded(rates(spark, folder, *HTTP).requests_by_status())


def _latency(sums, counts, where="true"):
    return f"""
select a.eval_ts, a.job, 1000 * a.value / greatest(b.value, 0.001e0) as value
from ({_sums(sums, 'job', where)}) a join ({_sums(counts, 'job', where)}) b on a.eval_ts = b.eval_ts and a.job = b.job
"""


@query(_rounded(_or(_latency(C.HTTP_SUM, C.HTTP_COUNT, JOBS), _latency(C.GATEWAY_SUM, C.GATEWAY_COUNT), ["job"]), "job"))
def avg_response_ms(spark, folder):
    return rounded(rates(spark, folder, *HTTP).avg_response_ms())


@query(_rounded(_latency(C.HTTP_SUM, C.HTTP_COUNT, JOBS), "job"))
def vector_divide(spark, folder):
    return rounded(rates(spark, folder, *HTTP).latency(C.HTTP_SUM, C.HTTP_COUNT, regex={"job": C.HTTP_JOBS}))


MONEY = "job in ('transaction-service', 'payment-service') and uri in ('/api/transactions/transfer', '/api/payments/checkout')"


@query(_rounded(_sums(C.HTTP_COUNT, "uri, status", "job = 'user-service' and regexp_full_match(uri, '/api/users/create|/api/users/login|/api/users/.*/balance')"), "uri, status"))
def user_traffic(spark, folder):
    return rounded(rates(spark, folder, C.HTTP_COUNT).user_traffic())


@query(_rounded(_sums(C.HTTP_COUNT, "job, status", MONEY), "job, status"))
def money_traffic(spark, folder):
    return rounded(rates(spark, folder, C.HTTP_COUNT).money_traffic())


@query(_rounded(_latency(C.HTTP_SUM, C.HTTP_COUNT, MONEY), "job"))
def money_latency(spark, folder):
    return rounded(rates(spark, folder, C.HTTP_COUNT, C.HTTP_SUM).money_latency())


@query(f'select eval_ts, route as "routeId", code as "httpStatusCode", round(value, 6) as value from ({_sums(C.GATEWAY_COUNT, "route, code")})')
def gateway_traffic(spark, folder):
    return rounded(rates(spark, folder, C.GATEWAY_COUNT).gateway_traffic())


@query("""
with a as (select ts, job, value from {m_up} where job <> 'user-service'), b as (select ts, job, value + 10 as value from {m_up})
select * from a union all select * from b where not exists (select 1 from a where a.ts = b.ts and a.job = b.job)
""")
def vector_or(spark, folder):
    rows = samples(spark, folder, "up").select("ts", F.col("labels")["job"].alias("job"), "value")
    other = rows.withColumn("value", F.col("value") + 10)
    return keyed.vector_or(rows.filter("job <> 'user-service'"), other, ["ts", "job"])


HEAP = "area = 'heap'"


def _latest(name, labels, where="true"):
    return f"""
select make_timestamp(cast(slot * {STEP} * 1000000 as bigint)) as eval_ts, {labels}, value from (
  select cast(ceil(epoch_us(ts) / 1e6 / {STEP}) as bigint) as slot, {labels}, arg_max(value, ts) as value from {{m_{name}}} where {where} group by all)
"""


@query(f"select eval_ts, job, sum(value) / 1048576 as value from ({_latest('jvm_memory_used_bytes', 'job, area', HEAP)}) group by all")
def heap_used_mb(spark, folder):
    return metrics.heap_used_mb(samples(spark, folder, "jvm_memory_used_bytes"), STEP)


@query(f"select eval_ts, job, round(avg(value) * 100, 6) as value from ({_latest('process_cpu_usage', 'job')}) group by all")
def cpu_percent(spark, folder):
    return rounded(metrics.cpu_percent(samples(spark, folder, "process_cpu_usage"), STEP))


@query(f"select eval_ts, job, avg(value) as value from ({_latest('jvm_threads_live_threads', 'job')}) group by all")
def live_threads(spark, folder):
    return metrics.live_threads(samples(spark, folder, "jvm_threads_live_threads"), STEP)


# --- alert rules ------------------------------------------------------------------------------------------

MAPPINGS["blocked_alerts"] = f"""
select make_timestamp(cast(slot * {STEP} * 1000000 as bigint)) as eval_ts, uri, increase as value from ({_ranges(C.HTTP_COUNT, "job = 'payment-service' and status = '400'")}) where increase > 0
"""


def blocked(spark, folder):
    return rules.blocked_payment_alerts(samples(spark, folder, C.HTTP_COUNT), WINDOW, STEP)


@query("""
select eval_ts, 'firing' as status, value, 'PaymentServiceBlockedPayments' as alertname, 'critical' as severity, '400' as code from {blocked_alerts}
""")
def blocked_payment_alerts(spark, folder):
    rows = blocked(spark, folder)
    return rows.select(
        "eval_ts", "status", "value", F.col("labels")["alertname"].alias("alertname"),
        F.col("labels")["severity"].alias("severity"), F.col("annotations")["statusCode"].alias("code"),
    )


@query("""
select cast(epoch(eval_ts) as bigint) as payload_id, 'PaymentServiceBlockedPayments' as alert_name, 'payment-service' as service_name, 'critical' as severity,
       'OPEN' as status, 'payment-blocked-alert' as trace_id, cast(400 as int) as status_code, 'PAYMENT_BLOCKED' as failure_type, eval_ts as created_at
from {blocked_alerts}
""")
def build_alert_payload(spark, folder):
    rows = blocked(spark, folder).withColumn("id", metrics.epoch_seconds(F.col("eval_ts")).cast("bigint"))
    documents = rules.build_alert_payload(rows, "id")
    return alerts.normalize_alerts(documents, A.EVENT_AS_OF).select(
        "payload_id", "alert_name", "service_name", "severity", "status", "trace_id", "status_code", "failure_type", "created_at"
    )


MAPPINGS["down_runs"] = """
select job, min(ts) as down_from, max(ts) as down_to, count(*) as samples from (
  select *, sum(case when down is distinct from was then 1 else 0 end) over (partition by job order by ts) as run from (
    select job, ts, value = 0 as down, lag(value = 0) over (partition by job order by ts) as was from {m_up}))
where down group by job, run
"""


MAPPINGS["down_alerts"] = """
select case job when 'user-service' then 'UserServiceDown' when 'payment-service' then 'PaymentServiceDown' else 'TransactionServiceDown' end as alertname,
       job, down_from, down_to, samples, down_from + interval '1800' second as fired_at,
       case job when 'user-service' then 'User service is down' when 'payment-service' then 'Payment service is down' else 'Transaction service is down' end as summary,
       'Prometheus detected ' || job || ' as unavailable' as description
from {down_runs} where epoch_us(down_to) - epoch_us(down_from) >= 1800 * 1000000
"""


@query("select * from {down_alerts}")
def service_down_alerts(spark, folder):
    return rules.service_down_alerts(samples(spark, folder, "up"), pending=1800.0, segment_seconds=86400.0)


@query(f"""
select j.job, case when value is null then 'NoData' when value < 1 then 'Alerting' else 'OK' end as state
from (values ('user-service'), ('payment-service'), ('transaction-service'), ('api-gateway')) j(job)
left join (select job, arg_max(value, ts) as value from {{m_up}} where ts <= timestamp '{A.EVENT_AS_OF}' and ts > timestamp '{A.EVENT_AS_OF}' - interval '600' second group by 1) u on u.job = j.job
""")
def no_data_state(spark, folder):
    jobs = ["user-service", "payment-service", "transaction-service", "api-gateway"]
    return rules.no_data_state(samples(spark, folder, "up"), jobs, A.EVENT_AS_OF, 600.0)


def _token(words):
    return rf"(?i)(^|[^\w.:'']|(^|\W)[.:''])({words})($|[^\w.:'']|[.:''](\W|$))"


MAPPINGS["rule_hits"] = rf"""
select ts, event_id, unnest(list_filter([
  case when regexp_matches(message, '{_token("PAYMENT_TIMEOUT")}') then 'Payment Timeout' end,
  case when regexp_matches(message, '{_token("Connection[^a-zA-Z0-9_]+refused")}') then 'Database Failure' end,
  case when regexp_matches(message, '{_token("LOGIN_FAILED")}') then 'Login Failure' end,
  case when regexp_matches(message, '{_token("Exception")}') or upper(level) = 'ERROR' then 'Java Exception' end], lambda x: x is not null)) as rule
from {{logs}}
"""
MAPPINGS["rule_runs"] = """
select rule, run_at, count(*) as hits from (
  select rule, time_bucket(interval '1 minute', ts) + unnest([1, 2, 3, 4, 5]) * interval '1 minute' as run_at from {rule_hits}) group by all
"""


@query("select * from {rule_runs}")
def log_pattern_alerts(spark, folder):
    return rules.log_pattern_alerts(logs(spark, folder))


@query("select rule, time_bucket(interval '1 minute', ts) + interval '1 minute' as run_at, count(*) as hits from {rule_hits} group by all")
def exclude_previous_hits(spark, folder):
    return rules.log_pattern_alerts(logs(spark, folder), exclude_previous_hits=True)


@query("""
select rule, 'active' as state, run_at as changed_at from {rule_runs} r where not exists (select 1 from {rule_runs} o where o.rule = r.rule and o.run_at = r.run_at - interval '1 minute')
union all
select rule, 'inactive', run_at + interval '1 minute' from {rule_runs} r where not exists (select 1 from {rule_runs} o where o.rule = r.rule and o.run_at = r.run_at + interval '1 minute')
""")
def on_state_change(spark, folder):
    return rules.on_state_change(rules.log_pattern_alerts(logs(spark, folder)), every=60.0)


@query("select service_name, time_bucket(interval '1 hour', ts) + interval '1 hour' as run_at, count(*) as hits from {logs} group by all")
def count_in_window(spark, folder):
    return rules.count_in_window(logs(spark, folder), ["service_name"], "1 hour")


@query("select event_id, ts, message from {logs} where ts = (select max(ts) from {logs})")
def latest_event(spark, folder):
    return rules.latest_event(logs(spark, folder).select("event_id", "ts", "message"))


MAPPINGS["login_events"] = """
select *, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as started from {logs} where contains(lower(message), 'invalid login failed as expected')
qualify row_number() over (partition by time_bucket(interval '1 minute', ts) order by ts desc) = 1
"""


@query("""
select * exclude (level), "startsAt" || ' ' || level || ' service=' || "serviceName" || ' traceId=' || "traceId"
  || ' status=401 failure=AUTH_LOGIN_FAILURE java.lang.IllegalStateException: ' || "errorMessage" as "rawLog"
from (select time_bucket(interval '1 minute', ts) + interval '1 minute' as run_at, 'Splunk Invalid Login Failure' as "alertName",
             service_name as "serviceName", case level when 'ERROR' then 'critical' else 'warning' end as severity, 'OPEN' as status, 'splunk' as source,
             md5(service_name || ':' || message || ':' || started) as "traceId", 401 as "statusCode", 'AUTH_LOGIN_FAILURE' as "failureType",
             message as "errorMessage", started as "startsAt", level from {login_events})
""")
def login_failure_alerts(spark, folder):
    return rules.login_failure_alerts(logs(spark, folder))


@query("""
select cast(epoch(run_at) as bigint) as payload_id, 'Splunk Invalid Login Failure' as alert_name, service_name, case level when 'ERROR' then 'critical' else 'warning' end as severity,
       'OPEN' as status, 'splunk' as source, md5(service_name || ':' || message || ':' || started) as trace_id, cast(401 as int) as status_code,
       'AUTH_LOGIN_FAILURE' as failure_type, message as error_message
from (select *, time_bucket(interval '1 minute', ts) + interval '1 minute' as run_at from {login_events})
""")
def search_result_payload(spark, folder):
    """Search alerts as documents, read back by the same rules as any alert."""
    rows = rules.login_failure_alerts(logs(spark, folder))
    rows = rows.withColumn("id", metrics.epoch_seconds(F.col("run_at")).cast("bigint"))
    return alerts.normalize_alerts(rules.search_result_payload(rows, "id"), A.EVENT_AS_OF).select(
        "payload_id", "alert_name", "service_name", "severity", "status", "source", "trace_id", "status_code", "failure_type", "error_message"
    )


@query("""
select event_id, case when event_id % 3 = 0 then 'incident-service-webhook' when event_id % 3 = 1 and service = 'user-service' then 'users' else 'default' end as receiver
from {event_fields}
""")
def route_alerts(spark, folder):
    rows = A.mapped(spark, folder, A.EVENT_FIELDS)
    team = F.when(F.col("event_id") % 3 == 0, C.TEAM).when(F.col("event_id") % 3 == 1, "other")
    labelled = rows.select("event_id", F.create_map(F.lit("team"), team, F.lit("job"), F.col("service")).alias("labels"))
    routes = [({"team": C.TEAM}, C.RECEIVER), ({"team": "other", "job": "user-service"}, "users")]
    return rules.route_alerts(labelled, routes, "default").select("event_id", "receiver")


MAPPINGS["notifications"] = """
with hits as (select rule, epoch_us(ts) / 1e6 as s from {rule_hits}),
marked as (select *, case when s - lag(s) over (partition by rule order by s) <= 3600 then 0 else 1 end as fresh from hits),
lives as (select rule, s, sum(fresh) over (partition by rule order by s rows unbounded preceding) as life from marked),
spans as (select *, min(s) over (partition by rule, life) as s0, max(s) over (partition by rule, life) as s1 from lives),
beats as (select rule, life, s0, s1, cast(greatest(0, ceil((s - s0 - 600) / 1800)) as bigint) as beat, count(*) as n from spans group by all),
nexts as (select *, lead(beat) over (partition by rule, life order by beat) as following, cast(floor((s1 + 3600 - s0 - 600) / 1800) as bigint) as last from beats),
sent as (select *, unnest(range(beat, greatest(beat, coalesce(following - 1, last)) + 1, 4)) as slot from nexts)
select rule, make_timestamp(cast(round((s0 + 600 + slot * 1800) * 1000000) as bigint)) as sent_at,
       case when slot > beat then 'repeat' when beat = 0 then 'first' else 'change' end as kind, case when slot = beat then n else 0 end as new_alerts
from sent
"""


@query("select * from {notifications}")
def group_notifications(spark, folder):
    hits = rules.log_rule_hits(logs(spark, folder)).select("rule", "ts")
    return rules.group_notifications(hits, ["rule"], wait=600.0, interval=1800.0, repeat=7200.0, lifetime=3600.0)


# --- alerts to incidents ----------------------------------------------------------------------------------

MAPPINGS["alert_requests"] = """
select payload_id as incident_id, raw_log, service_name, created_at as timestamp, trace_id, status_code, failure_type, error_message from {normalized}
"""
MAPPINGS["alert_parts"] = MAPPINGS["parsed_parts"].replace("{requests}", "{alert_requests}")
MAPPINGS["alert_messages"] = MAPPINGS["parsed_messages"].replace("{parsed_parts}", "{alert_parts}")
MAPPINGS["alert_parsed"] = MAPPINGS["parsed"].replace("{parsed_messages}", "{alert_messages}").replace(
    "when named_failure is not null then upper(replace(named_failure, '-', '_'))",
    "when coalesce(named_failure, nullif(failure_type, '')) is not null then upper(replace(coalesce(named_failure, nullif(failure_type, '')), '-', '_'))",
)


@query(f"""
select n.payload_id as id, n.alert_name, n.status, 'COMPLETED' as parser_status, coalesce(nullif(p.trace_id, ''), n.trace_id) as trace_id,
       p.failure_type, p.status_code, p.error_message, p.log_timestamp
from {{normalized}} n join {{alert_parsed}} p on p.incident_id = n.payload_id
""")
def alerts_to_incidents(spark, folder):
    documents = A.mapped(spark, folder, A.ALERT_PAYLOADS, heavy=True)
    rows = stage(alerts.normalize_alerts(documents, A.EVENT_AS_OF), "alerts")
    parsed = stage(parsing.parse_logs(alerts.parse_requests(rows)), "parsed-logs")
    marked = alerts.apply_parse_outcome(alerts.build_incidents(rows), parsed, A.EVENT_AS_OF)
    details = parsed.select(
        F.col("incident_id").alias("id"), "failure_type", "status_code", "error_message", "log_timestamp"
    )
    return marked.join(details, "id").select(
        "id", "alert_name", "status", "parser_status", "trace_id", "failure_type", "status_code", "error_message", "log_timestamp"
    )
