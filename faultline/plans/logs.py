"""Queries over logs and alerts."""

from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions import alertfields
from faultline.functions.labels import contains_text, has_phrase
from faultline.operators import alerts, ledger, parsing
from faultline.plans import adapters as A
from faultline.plans.registry import MAPPINGS, query
from faultline.session import scratch
from faultline.sources import logs as sources

MAPPINGS["parsed_parts"] = r"""
select r.*,
       nullif(regexp_extract(raw_log, '\b([A-Za-z0-9_.]+(?:Exception|Error))\b', 1), '') as exc,
       coalesce(try_cast(nullif(regexp_extract(raw_log, '\bstatus(?:Code)?[=:]\s*(\d{{3}})\b', 1, 'i'), '') as int), status_code) as code,
       nullif(regexp_extract(raw_log, '\bmessage[=:]\s*(.+)', 1, 'i'), '') as named_message,
       nullif(regexp_extract(raw_log, '\bfailure(?:Type)?[=:]\s*([A-Za-z0-9_-]+)\b', 1, 'i'), '') as named_failure,
       nullif(regexp_extract(raw_log, '(\d{{4}}-\d{{2}}-\d{{2}}[ T]\d{{2}}:\d{{2}}:\d{{2}})', 1), '') as stamp
from {requests} as r
"""
MAPPINGS["parsed_messages"] = r"""
select *,
       case when exc is not null and instr(raw_log, exc || ':') > 0 then trim(substr(raw_log, instr(raw_log, exc || ':') + length(exc) + 1))
            when named_message is not null then trim(named_message)
            when instr(raw_log, ' - ') > 0 then trim(substr(raw_log, instr(raw_log, ' - ') + 3))
            else coalesce(nullif(error_message, ''), trim(raw_log)) end as message
from {parsed_parts}
"""
MAPPINGS["parsed"] = r"""
select incident_id,
       coalesce(nullif(regexp_extract(raw_log, '\bservice(?:_name)?[=:]\s*([A-Za-z0-9._-]+)', 1), ''), service_name) as service_name,
       nullif(regexp_extract(raw_log, '\b(INFO|WARN|ERROR|DEBUG|TRACE|FATAL)\b', 1), '') as log_level,
       message as error_message,
       exc as exception_type,
       code as status_code,
       coalesce(nullif(regexp_extract(raw_log, '\btrace(?:Id|_id)?[=:]\s*([A-Za-z0-9-]+)\b', 1), ''), trace_id) as trace_id,
       case when named_failure is not null then upper(replace(named_failure, '-', '_'))
            when contains(lower(concat_ws(' ', exc, message, raw_log)), 'timeout') then 'TIMEOUT'
            when contains(lower(raw_log), 'invalid login') or contains(lower(raw_log), 'authentication') or code = 401 then 'AUTHENTICATION_FAILURE'
            when contains(lower(raw_log), 'blocked') and contains(lower(raw_log), 'payment') then 'PAYMENT_BLOCKED'
            when code >= 500 then 'SERVER_ERROR'
            when code >= 400 then 'CLIENT_ERROR'
            else 'APPLICATION_FAILURE' end as failure_type,
       coalesce(try_cast(replace(stamp, 'T', ' ') as timestamp), timestamp) as log_timestamp,
       raw_log
from {parsed_messages}
"""


def parsed(spark, folder):
    return parsing.parse_logs(A.mapped(spark, folder, A.PARSE_REQUESTS, heavy=True))


def logs(spark, folder):
    return A.mapped(spark, folder, A.LOG_EVENTS)


def payloads(spark, folder):
    return A.mapped(spark, folder, A.ALERT_PAYLOADS, heavy=True)


@query("select * from {parsed}")
def parse_logs(spark, folder):
    return parsed(spark, folder)


@query("""
select service_name, failure_type, count(*) as logs,
       count(*) filter (where status_code >= 500) as server_errors, max(log_timestamp) as last_seen
from {parsed} group by all
""")
def failure_counts(spark, folder):
    return parsing.failure_counts(parsed(spark, folder))


@query("""
select p.*, i.* from (
  select count(*) as logs, count(*) filter (where service_name is null) as service_name_missing,
         count(*) filter (where log_level is null) as log_level_missing,
         count(*) filter (where error_message is null) as error_message_missing,
         count(*) filter (where exception_type is null) as exception_type_missing,
         count(*) filter (where status_code is null) as status_code_missing,
         count(*) filter (where trace_id is null) as trace_id_missing,
         count(*) filter (where failure_type is null) as failure_type_missing,
         count(*) filter (where log_timestamp is null) as log_timestamp_missing
  from {parsed}) p,
 (select count(*) filter (where parser_status = 'COMPLETED') as parsed,
         count(*) filter (where parser_status = 'FAILED') as failed,
         count(*) filter (where parser_status = 'PENDING') as pending
  from {incidents}) i
""")
def parse_quality(spark, folder):
    return parsing.parse_quality(parsed(spark, folder), A.mapped(spark, folder, A.INCIDENTS))


FIELDS = {
    "extract_timestamp": "log_timestamp", "extract_service": "service_name", "extract_log_level": "log_level",
    "extract_status_code": "status_code", "extract_trace_id": "trace_id", "extract_exception": "exception_type",
    "extract_error_message": "error_message", "classify_failure": "failure_type",
}
for _name, _field in FIELDS.items():
    def _run(spark, folder, field=_field):
        return parsed(spark, folder).groupBy(field).agg(F.count("*").alias("logs"))

    query(f"select {_field}, count(*) as logs from {{parsed}} group by 1", _name)(_run)


# --- log sources and sinks --------------------------------------------------------------------------------

LOG_COLUMNS = ["ts", "level", "log_level", "logger_name", "service_name", "trace_id", "message", "exception"]
LOG_LIST = ", ".join(LOG_COLUMNS)


def _written_lines(spark, folder):
    path = scratch(spark, "log-lines")
    sources.to_json_lines(logs(spark, folder).select(*LOG_COLUMNS)).write.text(path)
    return path


@query(f"select {LOG_LIST} from {{logs}}")
def read_json_lines(spark, folder):
    return sources.read_json_lines(spark, _written_lines(spark, folder)).select(*LOG_COLUMNS)


@query(f"select {LOG_LIST} from {{logs}}")
def read_log_stream(spark, folder):
    from faultline.streaming.jobs import run_available

    stream = sources.read_log_stream(spark, _written_lines(spark, folder))
    return run_available(stream, "log-stream").select(*LOG_COLUMNS)


@query(f"""
select ts, level, logger_name, service_name, coalesce(trace_id, 'none') as trace_id, message, exception, context from (
  select ts, level, logger_name, service_name, trace_id, message, exception, 'bank' as context from {{logs}}
  union all select ts, level, logger_name, service_name, null, message, exception, null from {{logs}})
""")
def unify_log_layouts(spark, folder):
    """Both layouts as they are written and read back: one has trace id and context, the other stack traces."""
    events, paths = logs(spark, folder), [scratch(spark, name) for name in ("composite", "encoder")]
    common = ["ts", "level", "logger_name", "service_name", "message"]
    composite = events.select(*common, "trace_id", "exception", F.lit("bank").alias("context"))
    encoder = events.select(*common, F.col("exception").alias("stack_trace"), F.lit("main").alias("thread_name"))
    sources.to_json_lines(composite).write.text(paths[0])
    sources.to_json_lines(encoder).write.text(paths[1])
    both = sources.unify_log_layouts(*[sources.read_json_lines(spark, path) for path in paths])
    return both.select(*common, "trace_id", "exception", "context")


@query(f"""
select event_id, upper(coalesce(log_level, level)) as log_level, timestamp '{A.EVENT_AS_OF}' as ingested_at from {{logs}}
""")
def upper_log_level(spark, folder):
    events = sources.add_ingested_at(sources.upper_log_level(logs(spark, folder)), A.EVENT_AS_OF)
    return events.select("event_id", "log_level", "ingested_at")


@query("""
select strftime(ts, '%Y.%m.%d') as event_day, count(*) as logs, min(ts) as first_ts, max(ts) as last_ts
from {logs} group by 1
""")
def write_daily_logs(spark, folder):
    path = scratch(spark, "daily-logs")
    sources.write_daily_logs(logs(spark, folder), path)
    stored = sources.read_daily_logs(spark, path, "0000.00.00", "9999.99.99")
    return stored.groupBy(F.col("event_day").cast("string").alias("event_day")).agg(
        F.count("*").alias("logs"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query("""
select strftime(ts, '%Y.%m.%d') as event_day, count(*) as logs, count(*) as lines
from {logs} group by 1
""")
def fan_out_logs(spark, folder):
    table, lines = scratch(spark, "fan-table"), scratch(spark, "fan-lines")
    sources.fan_out_logs(logs(spark, folder).select("event_id", *LOG_COLUMNS), table, lines)
    days = F.date_format("ts", sources.DAY)
    written = sources.read_json_lines(spark, lines).groupBy(days.alias("event_day")).agg(F.count("*").alias("lines"))
    stored = spark.read.parquet(table).groupBy(days.alias("event_day")).agg(F.count("*").alias("logs"))
    return stored.join(written, "event_day")


@query("""
select incident_id, service_name, failure_type from {parsed} where incident_id % 2 = 0
union all select incident_id, 'fallback', null from {parsed} where incident_id % 2 = 1
""")
def read_with_fallback(spark, folder):
    from faultline.operators import keyed

    rows = parsed(spark, folder).select("incident_id", "service_name", "failure_type")
    secondary = rows.withColumns({"service_name": F.lit("fallback"), "failure_type": F.lit(None).cast("string")})
    return keyed.read_with_fallback(rows.filter("incident_id % 2 = 0"), secondary, "incident_id")


def _arrived(spark, folder):
    """Documents written as lines and read back; every third is cut off."""
    path = scratch(spark, "payloads")
    texts = payloads(spark, folder).select(F.when(F.col("payload_id") % 3 == 0, F.expr("left(payload, length(payload) - 1)")).otherwise(F.col("payload")).alias("value"))
    texts.write.text(path)
    return sources.read_alert_payloads(spark, path)


MAPPINGS["arrived"] = "select distinct case when payload_id % 3 = 0 then left(payload, length(payload) - 1) else payload end as payload from {payloads}"


@query("select md5(payload) as digest, 1::bigint as texts, true as own, true as again from {arrived}")
def read_alert_payloads(spark, folder):
    """An id stands for one text of one file, and a second read gives the same ids."""
    rows = _arrived(spark, folder)
    first = rows.select("payload_id", "payload", F.input_file_name().alias("file"))
    ids = first.groupBy("payload_id").agg(F.count_distinct("payload").alias("texts"))
    second = rows.select("payload_id", F.col("payload").alias("_payload")).distinct()
    known = first.join(ids, "payload_id").join(second, "payload_id", "left")
    return known.groupBy(F.md5("payload").alias("digest")).agg(
        F.max("texts").alias("texts"),
        (F.count_distinct("payload_id") == F.count_distinct("file")).alias("own"),
        F.bool_and(F.coalesce(F.col("payload") == F.col("_payload"), F.lit(False))).alias("again"),
    )


@query("select md5(payload) as digest, 'not a JSON object' as reject_reason from {arrived} where not json_valid(payload)")
def rejected_alerts(spark, folder):
    return alerts.rejected(_arrived(spark, folder)).select(F.md5("payload").alias("digest"), "reject_reason").distinct()


# --- log filters ------------------------------------------------------------------------------------------

@query(r"""
select event_id, message from {logs}
where regexp_matches(message, '(?i)(^|[^\w.:''])Exception($|[^\w.:'']|[.:''](\W|$))') or level = 'ERROR'
""")
def phrase_filter(spark, folder):
    rows = logs(spark, folder).filter(has_phrase(F.col("message"), "Exception") | (F.col("level") == "ERROR"))
    return rows.select("event_id", "message")


@query("select event_id, message from {logs} where contains(lower(message), 'invalid login failed as expected')")
def contains_filter(spark, folder):
    return logs(spark, folder).filter(contains_text(F.col("message"), C.LOGIN_PHRASE)).select("event_id", "message")


@query("""
select event_id, uri, case when starts_with(uri, '/api/users/') then 'user-service'
  when starts_with(uri, '/api/transactions/') then 'transaction-service'
  when starts_with(uri, '/api/payments/') then 'payment-service' end as service from {uris}
""")
def route_requests(spark, folder):
    return ledger.route_requests(A.mapped(spark, folder, A.REQUESTS))


# --- alert normalisation ----------------------------------------------------------------------------------

MAPPINGS["alert_nodes"] = r"""
select payload_id, received_at, payload, payload::json as doc,
       case when json_array_length(payload::json -> '$.alerts') > 0 then payload::json -> '$.alerts[0]' else payload::json end as alert
from {payloads}
"""


def _duck(paths, *defaults):
    """First non-blank of JSON paths in the checking SQL."""
    parts = []
    for path in paths:
        root, _, rest = path.partition(".")
        steps = ".".join(f'"{name}"' for name in rest.split("."))
        source = "alert" if root == "alert" else "doc"
        lead = "$.result." if root == "result" else "$."
        parts.append(f"nullif(trim(json_extract_string({source}, '{lead}{steps}')), '')")
    return "coalesce(" + ", ".join([*parts, *defaults]) + ")"


SEARCHED = "(nullif(trim(json_extract_string(doc, '$.search_name')), '') is not null)"
LEVEL = "upper(nullif(trim(json_extract_string(doc, '$.result.level')), ''))"
STARTED = _duck(C.ALERT_STARTED)
CODES = ", ".join(
    f"case when regexp_full_match({_duck([path])}, '[+-]?[0-9]+') then try_cast({_duck([path])} as int) end"
    for path in C.ALERT_STATUS_CODE
)
MAPPINGS["alert_fields"] = f"""
select payload_id, received_at, payload,
       {_duck(C.ALERT_NAME, "'PlatformIncident'")} as alert_name,
       {_duck(C.ALERT_SERVICE, "'unknown-service'")} as service_name,
       coalesce({_duck(C.ALERT_SEVERITY_FIRST)},
                case when {LEVEL} in ('ERROR', 'FATAL') then 'critical' when {LEVEL} in ('WARN', 'WARNING') then 'warning'
                     when {LEVEL} in ('INFO', 'DEBUG', 'TRACE') then 'info' else lower({LEVEL}) end,
                {_duck(C.ALERT_SEVERITY_LAST)}, 'warning') as severity,
       {_duck(C.ALERT_STATUS, f"case when {SEARCHED} then 'OPEN' else 'firing' end")} as raw_status,
       {_duck(C.ALERT_SOURCE, f"case when {SEARCHED} then 'splunk' else 'grafana-webhook' end")} as source,
       {_duck(C.ALERT_TRACE)} as named_trace,
       coalesce({CODES}) as status_code,
       {_duck(C.ALERT_FAILURE, "'APPLICATION_FAILURE'")} as failure_type,
       {_duck(C.ALERT_MESSAGE)} as named_message,
       coalesce(try_cast(replace(regexp_replace({STARTED}, '(Z|[+-][0-9][0-9]:[0-9][0-9])$', ''), 'T', ' ') as timestamp),
                timestamp '{A.EVENT_AS_OF}') as created_at,
       {_duck(C.ALERT_RAW_LOG)} as named_log
from {{alert_nodes}}
"""
MAPPINGS["alert_texts"] = """
select *, coalesce(named_trace, 'incident-' || replace(lower(alert_name), ' ', '-')) as trace_id,
       coalesce(named_message, alert_name || ' detected') as error_message,
       case upper(raw_status) when 'ACKNOWLEDGED' then 'ACKNOWLEDGED' when 'RESOLVED' then 'RESOLVED' when 'FAILED' then 'FAILED' else 'OPEN' end as status
from {alert_fields}
"""
MAPPINGS["normalized"] = """
select *, coalesce(named_log,
    strftime(created_at, '%Y-%m-%dT%H:%M:%S') || case when lower(severity) in ('critical', 'error') then ' ERROR' else ' WARN' end
    || ' service=' || service_name || ' traceId=' || trace_id || ' status=' || coalesce(cast(status_code as string), '500')
    || ' failure=' || failure_type || ' java.lang.IllegalStateException: ' || error_message) as raw_log
from {alert_texts}
"""
ALERT_COLUMNS = [
    "payload_id", "alert_name", "service_name", "severity", "raw_status", "status", "source", "trace_id",
    "status_code", "failure_type", "error_message", "created_at", "raw_log",
]


def normalized(spark, folder):
    return alerts.normalize_alerts(payloads(spark, folder), A.EVENT_AS_OF)


@query(f"select {', '.join(ALERT_COLUMNS)} from {{normalized}}")
def normalize_alerts(spark, folder):
    return normalized(spark, folder).select(*ALERT_COLUMNS)


@query("""
select payload_id, cast(i as int) as alert_index, json_extract_string(payload, '$.alerts[' || i || '].labels.alertname') as alert_name
from {payloads}, unnest(range(cast(json_array_length(payload::json -> '$.alerts') as bigint))) as t(i)
union all
select payload_id, null, coalesce(json_extract_string(payload, '$.result.alertName'), json_extract_string(payload, '$.alertName'),
       json_extract_string(payload, '$.search_name'), 'PlatformIncident')
from {payloads} where coalesce(json_array_length(payload::json -> '$.alerts'), 0) = 0
""")
def explode_alerts(spark, folder):
    rows = alerts.normalize_alerts(payloads(spark, folder), A.EVENT_AS_OF, mode="all")
    return rows.select("payload_id", "alert_index", "alert_name")


@query("""
select payload_id, upper(substr(regexp_replace(service_name, '[^A-Za-z0-9]', '', 'g'), 1, 8)) || '-' || upper(substr(md5(cast(payload_id as string)), 1, 8)) as number
from {normalized}
""")
def incident_numbers(spark, folder):
    rows = normalized(spark, folder)
    number = alertfields.incident_number(F.col("service_name"), F.col("payload_id"))
    return rows.select("payload_id", number.alias("number"))


@query("""
select payload_id as id, alert_name as title, error_message as description, 'PENDING' as parser_status,
       'Incident saved and waiting for parser response' as parser_message, status, created_at, created_at as updated_at, raw_log
from {normalized}
""")
def build_incidents(spark, folder):
    rows = alerts.build_incidents(normalized(spark, folder))
    return rows.select(
        "id", "title", "description", "parser_status", "parser_message", "status", "created_at", "updated_at", "raw_log"
    )


@query("""
select incident_id, case when trim(raw_log) = '' then 'No details returned'
  when length(raw_log) > 60 then substr(raw_log, 1, 60) || '...' else raw_log end as summary,
  case when length(raw_log || raw_log) > 180 then substr(raw_log || raw_log, 1, 180) || '...' else raw_log || raw_log end as long_summary
from {requests}
""")
def summarize_text(spark, folder):
    rows = A.mapped(spark, folder, A.PARSE_REQUESTS, heavy=True)
    twice = F.concat("raw_log", "raw_log")
    return rows.select(
        "incident_id", alertfields.summarize_text(F.col("raw_log"), 60).alias("summary"),
        alertfields.summarize_text(twice).alias("long_summary"),
    )


@query(f"""
select i.id, case when p.incident_id is not null then 'COMPLETED' else 'FAILED' end as parser_status,
       case when p.incident_id is not null then 'Parsed log stored successfully' else 'Log parser call failed: No details returned' end as parser_message,
       case when p.incident_id is not null then timestamp '{A.ORDER_AS_OF}' end as parsed_at,
       coalesce(p.trace_id, i.trace_id) as trace_id
from {{incidents}} i left join {{parsed}} p on p.incident_id = i.id
""")
def apply_parse_outcome(spark, folder):
    rows = alerts.apply_parse_outcome(A.mapped(spark, folder, A.INCIDENTS), parsed(spark, folder), A.ORDER_AS_OF)
    return rows.select("id", "parser_status", "parser_message", "parsed_at", "trace_id")
