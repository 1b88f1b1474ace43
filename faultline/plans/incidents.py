"""Queries over incidents, their life cycle and their dashboards."""

from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions import display as D
from faultline.functions.text import seconds_between
from faultline.operators import incidents as I
from faultline.operators import keyed
from faultline.operators.numbering import number_places
from faultline.plans import adapters as A
from faultline.plans.logs import parsed
from faultline.plans.registry import MAPPINGS, query
from faultline.session import stage
from faultline.sources import tables

AS_OF = A.ORDER_AS_OF

MAPPINGS["checks"] = """
select incident_id, incident_id % 7 = 0 as is_anomaly, (incident_id % 97) / 97.0e0 as anomaly_score,
       'reason ' || cast(incident_id % 3 as string) as reason, 'isolation-forest-v1' as model_version,
       log_timestamp as updated_at
from {parsed}
"""


def incidents(spark, folder):
    return A.mapped(spark, folder, A.INCIDENTS)


def checks(spark, folder):
    """Anomaly results with a rule in place of a model, so that the SQL can follow them."""
    number = F.col("incident_id")
    return parsed(spark, folder).select(
        "incident_id", (number % 7 == 0).alias("is_anomaly"), ((number % 97) / F.lit(97.0)).alias("anomaly_score"),
        F.concat(F.lit("reason "), (number % 3).cast("string")).alias("reason"),
        F.lit(C.MODEL_VERSION).alias("model_version"), F.col("log_timestamp").alias("updated_at"),
    )


# --- dashboards -------------------------------------------------------------------------------------------

@query("select count(*) as value from {incidents} where status <> 'RESOLVED'")
def active_incidents(spark, folder):
    return I.active_incidents(incidents(spark, folder))


@query("select count(*) as value from {incidents} where status <> 'RESOLVED' and lower(severity) in ('critical', 'error')")
def active_critical(spark, folder):
    return I.active_critical(incidents(spark, folder))


@query(f"""
select count(*) as value from {{incidents}}
where status = 'RESOLVED' and resolved_at > timestamp '{AS_OF}' - interval '24' hour
""")
def resolved_last_24h(spark, folder):
    return I.resolved_last_24h(incidents(spark, folder), AS_OF)


@query(f"""
select coalesce(round(avg((epoch_us(resolved_at) - epoch_us(created_at)) / 1e6 / 60), 6), 0) as value from {{incidents}}
where status = 'RESOLVED' and resolved_at > timestamp '{AS_OF}' - interval '7' day
""")
def mttr_minutes_7d(spark, folder):
    return I.mttr_minutes_7d(incidents(spark, folder), AS_OF).select(F.round("value", 6).alias("value"))


@query("select severity, count(*) as count from {incidents} group by 1")
def incidents_by_severity(spark, folder):
    return I.incidents_by(incidents(spark, folder), "severity")


@query("select coalesce(service_name, 'Unknown') as service, count(*) as count from {incidents} group by service_name")
def incidents_by_service(spark, folder):
    return I.incidents_by_service(incidents(spark, folder))


@query("select status, count(*) as count from {incidents} group by 1")
def incidents_by_status(spark, folder):
    return I.incidents_by(incidents(spark, folder), "status")


@query(f"""
select i.*, a.* from (
  select count(*) as total, count(*) filter (where status = 'OPEN') as open,
         count(*) filter (where parser_status = 'COMPLETED') as parsed,
         count(*) filter (where parser_status = 'FAILED') as failed,
         count(*) filter (where upper(severity) in ('CRITICAL', 'HIGH', 'ERROR')) as critical,
         count(*) filter (where created_at >= timestamp '2001-07-31 23:00:00' and created_at < timestamp '2001-08-01 23:00:00') as new_today
  from {{incidents}}) i, (select count(*) filter (where is_anomaly) as anomalies from {{checks}}) a
""")
def incident_summary(spark, folder):
    return I.incident_summary(incidents(spark, folder), checks(spark, folder), AS_OF)


@query("""
select incident_number as number, title as short_description, service_name as business_service, severity, status as state,
       strftime(created_at, '%Y-%m-%d %H:%M:%S') as created, coalesce(notes, 'In Queue') as resolution_notes from {incidents}
""")
def itsm_queue(spark, folder):
    return I.itsm_queue(incidents(spark, folder))


@query("""
select id, case severity when 'critical' then 2 when 'error' then 2 when 'warning' then 1 end as severity_rank,
       case status when 'OPEN' then 2 when 'ACKNOWLEDGED' then 1 when 'RESOLVED' then 0 end as state_rank,
       case status when 'ACKNOWLEDGED' then 1 when 'RESOLVED' then 0 end as plain_rank,
       case when resolved_at is null then null when date_diff('second', created_at, resolved_at) >= 45 * 60 then 'red'
            when date_diff('second', created_at, resolved_at) >= 15 * 60 then 'yellow' else 'green' end as mttr_band
from {incidents}
""")
def queue_bands(spark, folder):
    plain = I.queue_bands(incidents(spark, folder)).select("id", F.col("state_rank").alias("plain_rank"))
    return I.queue_bands(incidents(spark, folder), open_is_active=True).join(plain, "id")


# --- joins, filters, orders -------------------------------------------------------------------------------

@query("""
select i.id, i.service_name, p.incident_id is not null as has_log, p.service_name as log_service, p.failure_type, p.status_code
from {incidents} i left join {parsed} p on p.incident_id = i.id
""")
def incidents_with_parsed_logs(spark, folder):
    rows = I.incidents_with_parsed_logs(incidents(spark, folder), parsed(spark, folder))
    return rows.select(
        "id", "service_name", F.col("parsed_log").isNotNull().alias("has_log"),
        F.col("parsed_log.service_name").alias("log_service"), "parsed_log.failure_type", "parsed_log.status_code",
    )


@query("""
select i.id, case when c.incident_id is null then 'Not checked' when c.is_anomaly then 'Anomaly' else 'Normal' end as anomaly_label,
       case when c.incident_id is null then 'neutral' when c.is_anomaly then 'critical' else 'healthy' end as anomaly_tone, c.anomaly_score
from {incidents} i left join {checks} c on c.incident_id = i.id
""")
def incident_anomaly_join(spark, folder):
    newest = checks(spark, folder)
    older = newest.withColumns({"updated_at": F.expr("updated_at - interval '1' day"), "is_anomaly": ~F.col("is_anomaly")})
    rows = I.incident_anomaly_join(incidents(spark, folder), older.unionByName(newest))
    return rows.select("id", "anomaly_label", "anomaly_tone", "anomaly_score")


@query("""
select id from {incidents}
where trim(concat(coalesce(alert_name, ''), coalesce(service_name, ''), coalesce(severity, ''), coalesce(status, ''), coalesce(raw_log, ''), coalesce(notes, ''))) <> ''
""")
def has_signal(spark, folder):
    return I.has_signal(incidents(spark, folder)).select("id")


@query("select id, parser_status from {incidents} where upper(trim(parser_status)) = 'FAILED'")
def filter_parser_status(spark, folder):
    return I.filter_parser_status(incidents(spark, folder), "FAILED").select("id", "parser_status")


@query("""
select id from {incidents}
where contains(lower(coalesce(trim(alert_name), '') || ' ' || coalesce(trim(service_name), '') || ' ' || coalesce(trim(status), '')
  || ' ' || coalesce(trim(severity), '') || ' ' || coalesce(trim(trace_id), '') || ' ' || coalesce(trim(parser_message), '')
  || ' ' || coalesce(trim(raw_log), '') || ' ' || coalesce(trim(notes), '')), 'alert-1  open')
""")
def search_incidents(spark, folder):
    return I.search_incidents(incidents(spark, folder), "Alert-1  OPEN").select("id")


@query("select id, service_name from {incidents} where trace_id = 'trace-77'")
def lookup_by_key(spark, folder):
    return keyed.lookup_by_key(incidents(spark, folder), "trace_id", "trace-77").select("id", "service_name")


@query("select i.id, i.service_name from {incidents} i where i.id in (select incident_id from {updates})")
def lookup_by_keys(spark, folder):
    keys = A.mapped(spark, folder, A.INCIDENT_UPDATES).select("incident_id")
    return keyed.lookup_by_key(incidents(spark, folder), "id", keys).select("id", "service_name")


@query("select id from {incidents} where id <> 77")
def exclude_self(spark, folder):
    return keyed.exclude_self(incidents(spark, folder), "id", 77).select("id")


def positions(ordered):
    """The place of each row in an ordered result, seen from its own physical order."""
    stored = stage(ordered.withColumn("_physical", F.monotonically_increasing_id()), "ordered")
    return number_places(stored, "_physical", "position").drop("_physical")


PLACES = {
    "incidents_newest_first": "row_number() over (order by created_at desc nulls first, id)",
    "incidents_ui_order": "row_number() over (order by coalesce(created_at, timestamp '1970-01-01') desc, id desc)",
    "candidates_order": "row_number() over (order by resolved_at desc nulls first, updated_at desc nulls first, id desc)",
}
for _name, _order in {
    "incidents_newest_first": I.incidents_newest_first,
    "incidents_ui_order": I.incidents_ui_order,
    "candidates_order": I.candidates_order,
}.items():
    def _run(spark, folder, order=_order):
        return positions(order(incidents(spark, folder)).select("id", "created_at", "resolved_at", "updated_at"))

    query(f"select id, created_at, resolved_at, updated_at, {PLACES[_name]} as position from {{incidents}}", _name)(_run)


@query("select incident_id as id, log_timestamp as created_at, row_number() over (order by log_timestamp desc nulls first, incident_id desc) as position from {parsed}")
def parsed_logs_order(spark, folder):
    rows = parsed(spark, folder).select(F.col("incident_id").alias("id"), F.col("log_timestamp").alias("created_at"))
    return positions(I.parsed_logs_order(rows))


@query("select incident_id as id, updated_at, row_number() over (order by updated_at desc nulls first, incident_id desc) as position from {checks}")
def results_order(spark, folder):
    return positions(I.results_order(checks(spark, folder).select(F.col("incident_id").alias("id"), "updated_at")))


# --- life cycle and keyed tables --------------------------------------------------------------------------

MAPPINGS["valid_updates"] = """
select incident_id, changed_at, upper(nullif(trim(status), '')) as given, notes, resolved,
       row_number() over (partition by incident_id order by changed_at, seq) as step
from {updates} where nullif(trim(status), '') is null or upper(trim(status)) in ('OPEN', 'ACKNOWLEDGED', 'RESOLVED', 'FAILED')
"""


@query("""
with recursive folded as (
  select id, 0::bigint as step, status, resolved_at, notes, updated_at from {incidents}
  union all
  select s.id, s.step,
         case when s.resolved and s.next_status not in ('RESOLVED', 'CLOSED') then 'RESOLVED' else s.next_status end,
         case when s.resolved then s.changed_at
              when s.next_status in ('RESOLVED', 'CLOSED') then coalesce(s.resolved_at, s.changed_at)
              when s.resolved is not null or s.given is not null then null
              else s.resolved_at end,
         case when s.new_notes is null then s.notes else nullif(trim(s.new_notes), '') end,
         s.changed_at
  from (select f.id, u.step, coalesce(u.given, f.status) as next_status, u.given, u.resolved, u.changed_at, f.resolved_at, f.notes, u.notes as new_notes
        from folded f join {valid_updates} u on u.incident_id = f.id and u.step = f.step + 1) s
)
select id, status, resolved_at, notes, updated_at from folded
qualify row_number() over (partition by id order by step desc) = 1
""")
def apply_incident_updates(spark, folder):
    rows = I.apply_incident_updates(incidents(spark, folder), A.mapped(spark, folder, A.INCIDENT_UPDATES))
    return rows.select("id", "status", "resolved_at", "notes", "updated_at")


@query("""
select incident_id, seq, status, upper(nullif(trim(status), '')) is null or upper(trim(status)) in ('OPEN', 'ACKNOWLEDGED', 'RESOLVED', 'FAILED') as valid,
       case when upper(trim(status)) not in ('OPEN', 'ACKNOWLEDGED', 'RESOLVED', 'FAILED') then 'Unsupported incident status: ' || status end as reject_reason
from {updates}
""")
def valid_scenarios(spark, folder):
    rows = I.valid_scenarios(A.mapped(spark, folder, A.INCIDENT_UPDATES))
    return rows.select("incident_id", "seq", "status", "valid", "reject_reason")


@query("""
select incident_id, changed_at, seq, status from {updates}
qualify row_number() over (partition by incident_id order by changed_at desc, seq desc) = 1
""")
def latest_per_key(spark, folder):
    rows = A.mapped(spark, folder, A.INCIDENT_UPDATES).select("incident_id", "changed_at", "seq", "status")
    return keyed.latest_per_key(rows, ["incident_id"], ["changed_at", "seq"])


MAPPINGS["upsert_target"] = "select incident_id + 1000 as id, incident_id, failure_type, log_timestamp as created_at, log_timestamp as updated_at from {parsed}"


@query(f"""
with newest as (
  select incident_id, coalesce(status, 'none') as failure_type from {{updates}}
  qualify row_number() over (partition by incident_id order by changed_at desc, seq desc) = 1),
fresh as (
  select incident_id, row_number() over (order by incident_id) + (select max(id) from {{upsert_target}}) as new_id
  from newest where incident_id not in (select incident_id from {{upsert_target}}))
select coalesce(t.id, f.new_id) as id, coalesce(t.incident_id, n.incident_id) as incident_id,
       case when n.incident_id is not null then n.failure_type else t.failure_type end as failure_type,
       coalesce(t.created_at, timestamp '{AS_OF}') as created_at,
       case when n.incident_id is not null then timestamp '{AS_OF}' else t.updated_at end as updated_at
from {{upsert_target}} t full join newest n on n.incident_id = t.incident_id left join fresh f on f.incident_id = n.incident_id
""")
def upsert_by_key(spark, folder):
    target = parsed(spark, folder).select(
        (F.col("incident_id") + 1000).alias("id"), "incident_id", "failure_type",
        F.col("log_timestamp").alias("created_at"), F.col("log_timestamp").alias("updated_at"),
    )
    updates = A.mapped(spark, folder, A.INCIDENT_UPDATES).select(
        "incident_id", "changed_at", "seq", F.coalesce("status", F.lit("none")).alias("failure_type")
    )
    return keyed.upsert_by_key(target, updates, "incident_id", ["changed_at", "seq"], AS_OF)


@query("""
with news as (select distinct incident_id as id from {updates} where seq % 5 = 0)
select i.id, case when n.id is not null then 'changed' else i.status end as status, i.id as position
from {incidents} i left join news n on n.id = i.id
union all
select distinct incident_id + 10000000, 'changed', (select min(id) from {incidents}) - 1 from {updates} where seq % 7 = 0
""")
def merge_list(spark, folder):
    rows = incidents(spark, folder).select("id", "status", F.col("id").alias("position"))
    feed = A.mapped(spark, folder, A.INCIDENT_UPDATES)
    old = feed.filter("seq % 5 = 0").select(F.col("incident_id").alias("id"))
    new = feed.filter("seq % 7 = 0").select((F.col("incident_id") + 10000000).alias("id"))
    changed = old.union(new).distinct().withColumns({"status": F.lit("changed"), "position": F.lit(None).cast("bigint")})
    return keyed.merge_list(rows, changed, "id", "position")


# --- views ------------------------------------------------------------------------------------------------

ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || case when epoch_us({0}) % 1000000 = 0 then '' else strftime({0}, '.%f') end as {0}"


def _iso(name):
    return ISO.replace("{0}", name)


@query(f"""
select id, alert_name, title, description, incident_number, service_name, severity, status, source, raw_log, trace_id, parser_status,
       parser_message, {_iso('created_at')}, {_iso('parsed_at')}, {_iso('updated_at')}, {_iso('resolved_at')}, notes from {{incidents}}
""")
def incident_view(spark, folder):
    return I.incident_view(incidents(spark, folder))


@query(f"""
select incident_id, {_iso('log_timestamp').replace('as log_timestamp', 'as timestamp')}, service_name, log_level, error_message,
       exception_type, status_code, trace_id, failure_type, raw_log from {{parsed}}
""")
def parsed_log_view(spark, folder):
    return I.parsed_log_view(parsed(spark, folder))


@query(f"select incident_id, is_anomaly, anomaly_score, reason, model_version, {_iso('updated_at')} from {{checks}}")
def anomaly_view(spark, folder):
    return I.anomaly_view(checks(spark, folder))


@query(f"""
select incident_id, answer as recommended_root_cause, 'rules-and-similarity' as model_used, {_iso('updated_at')}
from (select a.*, i.updated_at from {{answers}} a join {{incidents}} i on i.id = a.incident_id) where incident_id % 2 = 0
""")
def recommendation_view(spark, folder):
    times = incidents(spark, folder).select(F.col("id").alias("incident_id"), "updated_at")
    rows = advice_rows(spark, folder).join(times, "incident_id")
    return I.recommendation_view(rows.select("incident_id", "recommended_root_cause", "model_used", "updated_at"))


@query("select o_orderkey, o_totalprice from {orders} where o_orderdate >= timestamp '2000-01-01 00:00:00'")
def scan_table(spark, folder):
    rows = tables.scan_table(spark, f"{folder}/orders.parquet")
    return rows.filter("o_orderdate >= timestamp_ntz '2000-01-01 00:00:00'").select("o_orderkey", "o_totalprice")


LOCAL = "strftime(timezone('Europe/Dublin', timezone('UTC', {0})), '%d/%m/%Y, %H:%M:%S')"


@query("""
select event_id, strftime(timezone('Europe/Dublin', timezone('UTC', ts + (event_id % 400) * interval '1' day)), '%Y-%m-%d') as day
from {event_fields}
""")
def local_day(spark, folder):
    rows = A.mapped(spark, folder, A.EVENT_FIELDS)
    moved = F.col("ts") + (F.col("event_id") % 400) * F.expr("interval '1' day")
    return rows.select("event_id", D.local_day(moved).alias("day"))


@query("""
select id, case when upper(severity) in ('CRITICAL', 'HIGH', 'ERROR') then 'critical' when upper(severity) in ('WARNING', 'MEDIUM', 'WARN') then 'warning' else 'info' end as severity_tone,
       case parser_status when 'COMPLETED' then 'healthy' when 'FAILED' then 'critical' else 'warning' end as parser_tone,
       case status when 'RESOLVED' then 'healthy' when 'FAILED' then 'critical' when 'ACKNOWLEDGED' then 'warning' else 'neutral' end as status_tone,
       coalesce(incident_number, 'INC-' || case when length(cast(id as string)) < 5 then lpad(cast(id as string), 5, '0') else cast(id as string) end) as number
from {incidents}
""")
def severity_tone(spark, folder):
    col = F.col
    return incidents(spark, folder).select(
        "id", D.severity_tone(col("severity")).alias("severity_tone"), D.parser_tone(col("parser_status")).alias("parser_tone"),
        D.status_tone(col("status")).alias("status_tone"),
        D.display_incident_number(col("incident_number"), col("id")).alias("number"),
    )


@query("""
select id, case when date_diff('second', created_at, updated_at) / 60.0e0 >= 45 then 'red' when date_diff('second', created_at, updated_at) / 60.0e0 >= 15 then 'yellow' else 'green' end as band
from {incidents}
""")
def threshold_band(spark, folder):
    minutes = seconds_between(F.col("created_at"), F.col("updated_at")) / 60
    return incidents(spark, folder).select("id", D.threshold_band(minutes, C.MTTR_BANDS).alias("band"))


MAPPINGS["shown"] = f"""
select i.id, coalesce(i.incident_number, 'INC-' || case when length(cast(i.id as string)) < 5 then lpad(cast(i.id as string), 5, '0') else cast(i.id as string) end) as number,
       i.alert_name, {LOCAL.replace('{0}', 'i.created_at')} as created, coalesce(i.service_name, 'unknown-service') as service_name,
       i.status, case i.status when 'RESOLVED' then 'healthy' when 'ACKNOWLEDGED' then 'warning' else 'neutral' end as status_tone,
       coalesce(i.severity, 'unknown') as severity,
       case when i.severity in ('critical', 'error') then 'critical' when i.severity = 'warning' then 'warning' else 'info' end as severity_tone,
       i.parser_status, case i.parser_status when 'COMPLETED' then 'healthy' when 'FAILED' then 'critical' else 'warning' end as parser_tone,
       case when c.incident_id is null then 'Not checked' when c.is_anomaly then 'Anomaly' else 'Normal' end as anomaly_label,
       case when c.incident_id is null then 'neutral' when c.is_anomaly then 'critical' else 'healthy' end as anomaly_tone,
       c.anomaly_score, i.trace_id
from {{incidents}} i left join {{checks}} c on c.incident_id = i.id
"""


@query("select * replace (case when anomaly_score is not null then printf('%.2f', anomaly_score) end as anomaly_score) from {shown}")
def incident_list_view(spark, folder):
    return I.incident_list_view(incidents(spark, folder), checks(spark, folder))


@query(f"""
select i.id, i.alert_name as title, coalesce(i.service_name, 'unknown-service') || ' | ' || {LOCAL.replace('{0}', 'i.created_at')} as meta,
       i.status, i.status as edit_status, coalesce(i.severity, 'unknown') as severity, i.parser_status,
       coalesce(i.parser_message, 'No parser message available.') as parser_message, i.trace_id, i.raw_log, coalesce(i.notes, '') as notes,
       {LOCAL.replace('{0}', 'i.updated_at')} as updated, 'Not available' as parsed,
       coalesce({LOCAL.replace('{0}', 'i.resolved_at')}, 'Not available') as resolved, i.source,
       p.incident_id is not null as has_parsed_log, coalesce(p.log_level, 'Not available') as log_level,
       coalesce(p.exception_type, 'Not available') as exception_type, coalesce(cast(p.status_code as string), 'Not available') as status_code,
       coalesce(p.failure_type, 'Not available') as failure_type, coalesce(p.error_message, 'Not available') as error_message,
       case when c.incident_id is null then 'Not checked' when c.is_anomaly then 'Anomaly' else 'Normal' end as anomaly_label,
       coalesce(printf('%.3f', c.anomaly_score), 'Not available') as anomaly_score, coalesce(c.reason, 'Not available') as anomaly_reason,
       coalesce(c.model_version, 'Isolation Forest') as anomaly_model, a.incident_id is not null and a.incident_id % 2 = 0 as has_recommendation,
       case when a.incident_id % 2 = 0 then a.answer end as recommended_root_cause, case when a.incident_id % 2 = 0 then a.model end as recommended_fix
from {{incidents}} i left join {{parsed}} p on p.incident_id = i.id left join {{checks}} c on c.incident_id = i.id
left join {{answers}} a on a.incident_id = i.id
""")
def incident_detail_view(spark, folder):
    return I.incident_detail_view(
        incidents(spark, folder), parsed(spark, folder), checks(spark, folder), advice_rows(spark, folder)
    )


def advice_rows(spark, folder):
    """Stored recommendations for every second incident, made from the answer texts."""
    rows = A.mapped(spark, folder, A.ANSWERS).filter("incident_id % 2 = 0")
    return rows.select(
        "incident_id", (F.col("incident_id") + 1).alias("similar_incident_id"), F.lit(0.5).alias("similarity_score"),
        F.col("answer").alias("recommended_root_cause"), F.col("model").alias("recommended_fix"),
        F.lit("e").alias("evidence"), F.lit(C.RULES_MODEL).alias("model_used"),
    )


@query("""
select i.id, i.id % 2 = 0 as has_recommendation, case when i.id % 2 = 0 then i.id + 1 end as similar_incident_id
from {incidents} i
""")
def incident_recommendation_join(spark, folder):
    rows = I.incident_recommendation_join(incidents(spark, folder), advice_rows(spark, folder))
    return rows.select("id", "has_recommendation", "similar_incident_id")
