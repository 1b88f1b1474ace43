"""Incident analytics: joins, dashboards, orders, search, life cycle, views."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions import display as D
from faultline.functions.text import (
    EPOCH, blank_to_null, chain, empty_to_null, instant, is_blank, seconds_between, strip, text_or,
)
from faultline.operators.keyed import latest_per_key, packed_order
from faultline.session import stage

PARSED_FIELDS = [
    "id", "incident_id", "log_timestamp", "service_name", "log_level", "error_message", "exception_type",
    "status_code", "trace_id", "failure_type", "raw_log", "created_at",
]
SEARCHED = [
    "alert_name", "service_name", "status", "severity", "trace_id", "parser_message", "raw_log", "notes",
]
SIGNALS = ["alert_name", "service_name", "severity", "status", "raw_log", "notes"]
PARSED_SIGNALS = ["failure_type", "exception_type", "error_message"]
ISO = "yyyy-MM-dd'T'HH:mm:ss"


# --- joins ------------------------------------------------------------------------------------------------

def incidents_with_parsed_logs(incidents: DataFrame, parsed: DataFrame) -> DataFrame:
    """Every incident with its parsed log as a nested struct, null when it has none."""
    nested = F.struct(*[c for c in PARSED_FIELDS if c in parsed.columns])
    logs = parsed.select(F.col("incident_id").alias("_key"), nested.alias("parsed_log"))
    return incidents.join(logs, incidents["id"] == logs["_key"], "left").drop("_key")


def first_result(results: DataFrame) -> DataFrame:
    """The first result of each incident in the order of results (newest, then largest id)."""
    marked = results.withColumn("_no_time", F.col("updated_at").isNull())
    order = ["_no_time", *[c for c in ("updated_at", "id") if c in results.columns]]
    return latest_per_key(marked, ["incident_id"], order).drop("_no_time")


def incident_anomaly_join(incidents: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Incidents with the label, tone, score and reason of their first anomaly check."""
    checks = first_result(anomalies).select(
        F.col("incident_id").alias("_key"), "is_anomaly", "anomaly_score",
        F.col("reason").alias("anomaly_reason"), F.col("model_version").alias("anomaly_model"),
        F.col("updated_at").alias("anomaly_updated_at"),
    )
    joined = incidents.join(checks, incidents["id"] == checks["_key"], "left")
    checked = F.col("_key").isNotNull()
    return joined.withColumns(
        {
            "anomaly_label": D.anomaly_label(checked, F.col("is_anomaly")),
            "anomaly_tone": D.anomaly_tone(checked, F.col("is_anomaly")),
        }
    ).drop("_key")


def incident_recommendation_join(incidents: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Incidents with their first recommendation."""
    firsts = first_result(recommendations) if "updated_at" in recommendations.columns else recommendations
    advice = firsts.select(
        F.col("incident_id").alias("_key"), "similar_incident_id", "similarity_score",
        "recommended_root_cause", "recommended_fix", "evidence", "model_used",
    )
    joined = incidents.join(advice, incidents["id"] == advice["_key"], "left")
    return joined.withColumn("has_recommendation", F.col("_key").isNotNull()).drop("_key")


# --- filters ----------------------------------------------------------------------------------------------

def signal_of(incidents: DataFrame) -> Column:
    """Whether any of the fields that similarity reads has text."""
    nested = [F.col(f"parsed_log.{name}") for name in PARSED_SIGNALS] if "parsed_log" in incidents.columns else []
    return ~is_blank(F.concat_ws("", *[F.col(c) for c in SIGNALS], *nested))


def has_signal(incidents: DataFrame) -> DataFrame:
    """Keep incidents with text in any of the fields that similarity reads."""
    return incidents.filter(signal_of(incidents))


def filter_parser_status(incidents: DataFrame, status: str = "ALL") -> DataFrame:
    if status == "ALL":
        return incidents
    return incidents.filter(F.upper(strip(F.col("parser_status"))) == status)


def search_incidents(incidents: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring over the searched fields joined by blanks; no text keeps all."""
    if not text:
        return incidents
    fields = [F.coalesce(strip(F.col(name)), F.lit("")) for name in SEARCHED]
    return incidents.filter(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(text.lower())))


def valid_scenarios(updates: DataFrame) -> DataFrame:
    """Normalised status and the reason for updates whose status is not allowed."""
    name = F.upper(blank_to_null(F.col("status")))
    wrong = name.isNotNull() & ~name.isin(C.MANUAL_STATUSES)
    return updates.withColumns(
        {
            "valid": ~F.coalesce(wrong, F.lit(False)),
            "reject_reason": F.when(wrong, F.concat(F.lit(C.UNSUPPORTED_STATUS), "status")),
        }
    )


# --- dashboards -------------------------------------------------------------------------------------------

def is_active(status: Column) -> Column:
    return status != "RESOLVED"


def active_incidents(incidents: DataFrame) -> DataFrame:
    return incidents.filter(is_active(F.col("status"))).agg(F.count("*").alias("value"))


def active_critical(incidents: DataFrame) -> DataFrame:
    severe = F.lower("severity").isin("critical", "error")
    return incidents.filter(is_active(F.col("status")) & severe).agg(F.count("*").alias("value"))


def _resolved_within(incidents: DataFrame, as_of, interval: str) -> DataFrame:
    since = instant(as_of) - F.expr(f"INTERVAL {interval}")
    return incidents.filter((F.col("status") == "RESOLVED") & (F.col("resolved_at") > since))


def resolved_last_24h(incidents: DataFrame, as_of=None) -> DataFrame:
    return _resolved_within(incidents, as_of, "'24' HOUR").agg(F.count("*").alias("value"))


def mttr_minutes_7d(incidents: DataFrame, as_of=None) -> DataFrame:
    """Mean minutes from creation to resolution over the last week, 0 without resolved incidents."""
    minutes = seconds_between(F.col("created_at"), F.col("resolved_at")) / 60
    return _resolved_within(incidents, as_of, "'7' DAY").agg(
        F.coalesce(F.avg(minutes), F.lit(0.0)).alias("value")
    )


def incidents_by(incidents: DataFrame, column: str) -> DataFrame:
    return incidents.groupBy(column).agg(F.count("*").alias("count"))


def incidents_by_service(incidents: DataFrame) -> DataFrame:
    """Counts per raw service name; a missing name is labelled after grouping, so it stays its own row."""
    counts = incidents_by(incidents, "service_name")
    return counts.select(F.coalesce("service_name", F.lit("Unknown")).alias("service"), "count")


def incident_summary(incidents: DataFrame, anomalies: DataFrame, as_of=None) -> DataFrame:
    """All tiles of the incident page in one row."""
    status, parser = F.upper(strip(F.col("status"))), F.upper(strip(F.col("parser_status")))
    today = D.local_day(instant(as_of))
    tiles = incidents.agg(
        F.count("*").alias("total"),
        F.count_if(status == "OPEN").alias("open"),
        F.count_if(parser == "COMPLETED").alias("parsed"),
        F.count_if(parser == "FAILED").alias("failed"),
        F.count_if(D.severity_tone(F.col("severity")) == "critical").alias("critical"),
        F.count_if(D.local_day(F.col("created_at")) == today).alias("new_today"),
    )
    return tiles.withColumn("anomalies", anomalies.agg(F.count_if("is_anomaly")).scalar())


def itsm_queue(incidents: DataFrame) -> DataFrame:
    return incidents_newest_first(incidents).select(
        F.col("incident_number").alias("number"),
        F.col("title").alias("short_description"),
        F.col("service_name").alias("business_service"),
        "severity",
        F.col("status").alias("state"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"),
        F.coalesce("notes", F.lit("In Queue")).alias("resolution_notes"),
    )


def queue_bands(incidents: DataFrame, open_is_active: bool = False) -> DataFrame:
    """Ranks and colours of the queue's severity and state cells."""
    return incidents.select(
        "id",
        D.severity_rank(F.col("severity")).alias("severity_rank"),
        D.state_rank(F.col("status"), open_is_active).alias("state_rank"),
        D.threshold_band(
            seconds_between(F.col("created_at"), F.col("resolved_at")) / 60, C.MTTR_BANDS
        ).alias("mttr_band"),
    )


# --- orders -----------------------------------------------------------------------------------------------

def incidents_newest_first(incidents: DataFrame) -> DataFrame:
    return incidents.orderBy(F.col("created_at").desc_nulls_first(), "id")


def incidents_ui_order(incidents: DataFrame) -> DataFrame:
    created = F.coalesce("created_at", F.lit(EPOCH).cast("timestamp_ntz"))
    return incidents.orderBy(created.desc(), F.col("id").desc())


def parsed_logs_order(parsed: DataFrame) -> DataFrame:
    return parsed.orderBy(F.col("created_at").desc_nulls_first(), F.col("id").desc())


def results_order(results: DataFrame) -> DataFrame:
    return results.orderBy(F.col("updated_at").desc_nulls_first(), F.col("id").desc())


def candidate_order() -> list[Column]:
    return [
        F.col("resolved_at").desc_nulls_first(), F.col("updated_at").desc_nulls_first(), F.col("id").desc(),
    ]


def candidates_order(incidents: DataFrame) -> DataFrame:
    return incidents.orderBy(*candidate_order())


# --- life cycle -------------------------------------------------------------------------------------------

def apply_incident_updates(incidents: DataFrame, updates: DataFrame) -> DataFrame:
    """State of each incident after its change feed, in the order (changed_at, seq).

    The fold is stated as minima and maxima of one order number per incident, which are hash aggregates, so a hot
    incident is reduced before any shuffle and no history is gathered. The feed is scanned once; what lies behind the last clearing
    update and the text of the last notes are then looked up in its staged marks. Updates with an unsupported status are
    rejected whole.

    A setter gives a status or asks for resolution. A clearing update gives an unresolved status.
    Behind the last clearing update the resolution time is that of the last request to resolve, else
    of the first RESOLVED status.
    """
    col, lit = F.col, F.lit
    valid = valid_scenarios(updates).filter("valid")
    feed = stage(
        valid.select(
            col("incident_id").alias("key"),
            packed_order(valid, ["changed_at", "seq"]).alias("at"),
            "changed_at",
            F.upper(blank_to_null(col("status"))).alias("given"),
            F.coalesce("resolved", lit(False)).alias("resolve"),
            (col("resolved") == lit(False)).alias("_reopen"),
            col("notes").alias("new_notes"),
        ), "feed",
    )
    has_status = col("given").isNotNull()
    clears = has_status & (col("given") != "RESOLVED") & ~col("resolve")
    folded = feed.groupBy("key").agg(
        F.max("at").alias("last"),
        F.max("changed_at").alias("last_time"),
        F.min("changed_at").alias("first_time"),
        F.max(F.when(has_status, col("at"))).alias("last_status"),
        F.min(F.when(has_status | col("resolve"), col("at"))).alias("first_setter"),
        F.max(F.when(col("resolve"), col("at"))).alias("resolve_at"),
        F.max(F.when(col("resolve"), col("changed_at"))).alias("resolve_time"),
        F.max(F.when(clears, col("at"))).alias("cleared"),
        F.min(F.when(~has_status & col("_reopen"), col("at"))).alias("first_reopen"),
        F.max(F.when(col("new_notes").isNotNull(), col("at"))).alias("notes_at"),
        *[F.max(F.when((col("given") == name) & ~col("resolve"), col("at"))).alias(f"set_{name}") for name in C.MANUAL_STATUSES],
    )
    marks = folded.select(col("key").alias("_key"), "cleared", "notes_at")
    behind = col("cleared").isNull() | (col("at") > col("cleared"))
    resolving = feed.filter((col("given") == "RESOLVED") & ~col("resolve")).select("key", "at", "changed_at")
    first_resolving = resolving.join(marks, col("key") == col("_key")).filter(behind).groupBy("_key").agg(
        F.min("changed_at").alias("resolving_time"))
    # Updates of one place tie; one of them is kept before they meet.
    one = F.row_number().over(Window.partitionBy("key").orderBy("at"))
    noted = feed.filter("new_notes is not null").select("key", "at", "new_notes")
    noted = noted.join(marks, (col("key") == col("_key")) & (col("at") == col("notes_at"))).withColumn("_n", one)
    noted = noted.filter("_n = 1").select(col("key").alias("_key"), "new_notes")
    state = incidents
    for found, key in ((folded, "key"), (first_resolving, "_key"), (noted, "_key")):
        found = found.withColumnRenamed(key, "_found")
        state = state.join(found, F.col("id") == F.col("_found"), "left").drop("_found")

    was_closed = F.upper(blank_to_null(col("status"))).isin(C.CLOSED_STATUSES)
    was_closed = F.coalesce(was_closed, lit(False))
    setter = F.greatest("resolve_at", *[col(f"set_{name}") for name in C.MANUAL_STATUSES])
    status = chain(
        [
            (setter.isNull(), col("status")),
            *[(col(f"set_{name}") == setter, lit(name)) for name in C.MANUAL_STATUSES],
            (was_closed & col("last_status").isNull(), col("status")),
        ],
        lit("RESOLVED"),
    )
    # A reopen request before any setter drops a leftover time of an unresolved incident.
    dropped = ~was_closed & col("first_reopen").isNotNull() & (
        col("first_setter").isNull() | (col("first_reopen") < col("first_setter"))
    )
    kept = F.when(~dropped, col("resolved_at"))
    after_clear = col("cleared").isNull() | (col("resolve_at") > col("cleared"))
    resolved_at = chain(
        [
            (col("last").isNull(), col("resolved_at")),
            (col("resolve_at").isNotNull() & after_clear, col("resolve_time")),
            (col("cleared").isNotNull(), col("resolving_time")),
            (kept.isNotNull(), kept),
            (was_closed, col("first_time")),
        ],
        col("resolving_time"),
    )
    notes = F.when(col("notes_at").isNotNull(), blank_to_null(col("new_notes"))).otherwise(col("notes"))
    changes = {
        "status": status,
        "resolved_at": resolved_at,
        "notes": notes,
        "updated_at": F.coalesce("last_time", "updated_at"),
    }
    return state.select(*[changes.get(c, col(c)).alias(c) for c in incidents.columns])


# --- views ------------------------------------------------------------------------------------------------

def _iso(name: str) -> Column:
    """ISO text of a time; the fraction is shown only when there is one."""
    micros = F.date_format(name, "SSSSSS")
    fraction = F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(F.lit(""))
    return F.concat(F.date_format(name, ISO), fraction).alias(name)


def _with_iso(rows: DataFrame) -> DataFrame:
    times = {f.name for f in rows.schema.fields if f.dataType.typeName().startswith("timestamp")}
    return rows.select(*[_iso(c) if c in times else F.col(c) for c in rows.columns])


def parsed_log_view(parsed: DataFrame) -> DataFrame:
    view = parsed.select(*[c for c in PARSED_FIELDS if c in parsed.columns])
    return _with_iso(view.withColumnRenamed("log_timestamp", "timestamp"))


def anomaly_view(results: DataFrame) -> DataFrame:
    return _with_iso(results)


def recommendation_view(results: DataFrame) -> DataFrame:
    return _with_iso(results)


def incident_view(incidents: DataFrame) -> DataFrame:
    return _with_iso(incidents.drop("raw_payload"))


def incident_list_view(incidents: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One display row per incident, defaults for missing values."""
    col = F.col
    return incident_anomaly_join(incidents, anomalies).select(
        "id",
        D.display_incident_number(col("incident_number"), col("id")).alias("number"),
        text_or(col("alert_name"), C.UNTITLED).alias("alert_name"),
        D.format_local(col("created_at")).alias("created"),
        text_or(col("service_name"), C.DEFAULT_SERVICE).alias("service_name"),
        text_or(col("status"), "OPEN").alias("status"),
        D.status_tone(col("status")).alias("status_tone"),
        text_or(col("severity"), "unknown").alias("severity"),
        D.severity_tone(col("severity")).alias("severity_tone"),
        text_or(col("parser_status"), "PENDING").alias("parser_status"),
        D.parser_tone(col("parser_status")).alias("parser_tone"),
        "anomaly_label", "anomaly_tone",
        F.format_string("%.2f", "anomaly_score").alias("_score"),
        "anomaly_score",
        text_or(col("trace_id"), C.NOT_AVAILABLE).alias("trace_id"),
    ).withColumn("anomaly_score", F.when(col("anomaly_score").isNotNull(), col("_score"))).drop("_score")


def incident_detail_view(
    incidents: DataFrame, parsed: DataFrame, anomalies: DataFrame, recommendations: DataFrame
) -> DataFrame:
    """One display row per incident with its log, anomaly and recommendation."""
    col = F.col

    def shown(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit(C.NOT_AVAILABLE))

    rows = incidents_with_parsed_logs(incidents, parsed)
    rows = incident_recommendation_join(incident_anomaly_join(rows, anomalies), recommendations)
    listed = col("status").isin(C.MANUAL_STATUSES)
    return rows.select(
        "id",
        text_or(col("alert_name"), C.UNTITLED).alias("title"),
        F.concat(
            text_or(col("service_name"), C.DEFAULT_SERVICE), F.lit(" | "), D.format_local(col("created_at"))
        ).alias("meta"),
        text_or(col("status"), "OPEN").alias("status"),
        F.when(listed, col("status")).otherwise(F.lit("OPEN")).alias("edit_status"),
        text_or(col("severity"), "unknown").alias("severity"),
        text_or(col("parser_status"), "PENDING").alias("parser_status"),
        text_or(col("parser_message"), "No parser message available.").alias("parser_message"),
        text_or(col("trace_id"), "Trace id not available").alias("trace_id"),
        text_or(col("raw_log"), C.NO_RAW_LOG).alias("raw_log"),
        text_or(col("notes"), "").alias("notes"),
        D.format_local(col("updated_at")).alias("updated"),
        D.format_local(col("parsed_at")).alias("parsed"),
        D.format_local(col("resolved_at")).alias("resolved"),
        text_or(col("source"), "Unknown").alias("source"),
        col("parsed_log").isNotNull().alias("has_parsed_log"),
        shown(col("parsed_log.log_level")).alias("log_level"),
        shown(col("parsed_log.exception_type")).alias("exception_type"),
        shown(col("parsed_log.status_code")).alias("status_code"),
        shown(col("parsed_log.failure_type")).alias("failure_type"),
        shown(col("parsed_log.error_message")).alias("error_message"),
        "anomaly_label",
        F.when(col("anomaly_score").isNotNull(), F.format_string("%.3f", "anomaly_score"))
        .otherwise(F.lit(C.NOT_AVAILABLE)).alias("anomaly_score"),
        shown(col("anomaly_reason")).alias("anomaly_reason"),
        text_or(col("anomaly_model"), "Isolation Forest").alias("anomaly_model"),
        "has_recommendation",
        empty_to_null(col("recommended_root_cause")).alias("recommended_root_cause"),
        empty_to_null(col("recommended_fix")).alias("recommended_fix"),
    )
