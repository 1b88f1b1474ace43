"""Alert payloads of several monitoring tools to incident rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import constants as C
from faultline import schemas
from faultline.functions import alertfields as A
from faultline.functions.text import CONTROL_SPACE, UNICODE_SPACE, blank_to_null_sql, instant, is_blank, sql_text

CONTAINER_TYPE = "^(OBJECT|ARRAY)"


def accepted(payloads: DataFrame) -> DataFrame:
    """Documents that are JSON objects; only these become incidents."""
    return payloads.filter(F.json_object_keys("payload").isNotNull())


def rejected(payloads: DataFrame) -> DataFrame:
    """The other documents, with a reason."""
    wrong = payloads.filter(F.json_object_keys("payload").isNull())
    reason = F.when(is_blank(F.col("payload")), "empty document").otherwise("not a JSON object")
    return wrong.withColumn("reject_reason", reason)


def explode_alerts(payloads: DataFrame, mode: str = "first") -> DataFrame:
    """Parse each accepted document once and choose its alert node.

    `first` keeps alerts[0] only; `all` gives one row per alert. With no alerts the payload is the node.
    """
    parsed = accepted(payloads).withColumn("doc", F.from_json("payload", schemas.ALERT_JSON))
    own = F.struct("doc.status", "doc.startsAt", "doc.labels", "doc.annotations")
    has_alerts = F.coalesce(F.size("doc.alerts"), F.lit(0)) > 0
    if mode == "first":
        return parsed.withColumns(
            {
                "alert_index": F.when(has_alerts, F.lit(0)),
                "alert": F.when(has_alerts, F.get("doc.alerts", F.lit(0))).otherwise(own),
            }
        )
    if mode != "all":
        raise ValueError(f"unknown mode {mode}")
    spread = F.when(has_alerts, F.col("doc.alerts")).otherwise(F.array(own))
    return parsed.select(
        "*", F.posexplode(spread).alias("position", "alert")
    ).withColumn("alert_index", F.when(has_alerts, F.col("position"))).drop("position")


#: Sources of every field in order; a field that tries each source in a way of its own has one group per source.
FIELDS = {
    "alert_name": C.ALERT_NAME, "service_name": C.ALERT_SERVICE, "severity_first": C.ALERT_SEVERITY_FIRST,
    "level": ["result.level"], "severity_last": C.ALERT_SEVERITY_LAST, "status": C.ALERT_STATUS, "source": C.ALERT_SOURCE,
    "search_name": ["$.search_name"], "trace_id": C.ALERT_TRACE, "failure_type": C.ALERT_FAILURE,
    "error_message": C.ALERT_MESSAGE, "raw_log": C.ALERT_RAW_LOG,
    **{f"status_code_{i}": [source] for i, source in enumerate(C.ALERT_STATUS_CODE)},
    **{f"started_{i}": [source] for i, source in enumerate(C.ALERT_STARTED)},
}


def _text(source: str) -> str:
    """Text of one source path as written in the document."""
    root, name, *label = source.split(".")
    start = {"$": "doc", "result": "doc.result", "alert": "alert"}[root]
    return f"{start}.`{name}`" + "".join(f"['{part}']" for part in label)


def _steps(source: str) -> str:
    return "".join(f'["{name}"]' for name in source.split(".")[1:])


def _first_usable(sources: list[str]) -> str:
    """The first usable text of some sources, each of them tried."""
    whole = ", ".join(f"'{'$.result' if s.startswith('result.') else '$'}{_steps(s)}'" for s in sources)
    listed = ", ".join(f"'{_steps(s)}'" if s.startswith("alert.") else "cast(null as string)" for s in sources)
    place = (
        f"coalesce(concat('$.alerts[', cast(alert_index as string), ']', element_at(array({listed}), i + 1)), "
        f"element_at(array({whole}), i + 1))"
    )
    node = f"try_variant_get(try_parse_json(payload), {place}, 'variant')"
    nested = f"coalesce(schema_of_variant({node}) rlike '{CONTAINER_TYPE}', false)"
    trimmed = blank_to_null_sql("x")
    usable = (
        f"transform(array({', '.join(map(_text, sources))}), (x, i) -> case when substring(x, 1, 1) in ('{{', '[') "
        f"then case when not {nested} then {trimmed} end else {trimmed} end)"
    )
    return f"get(filter({usable}, x -> x is not null), 0)"


def read_sources(alerts: DataFrame) -> DataFrame:
    """Trimmed text of every field as `_<field>`: the first of its sources that is usable.

    Blank text and nested objects count as absent. The first text present is nearly always usable and then is the answer; only
    where it is blank or begins like an object are all sources of the field tried. A text that begins like an object is looked
    up again as a typed node, which tells an object from a text that looks like one.
    """
    kept = [f"`{name}`" for name in alerts.columns if name not in ("doc", "alert")]
    present = [f"coalesce({', '.join(map(_text, sources))}) as _present_{name}" for name, sources in FIELDS.items()]
    found = []
    for name, sources in FIELDS.items():
        text = f"_present_{name}"
        plain = f"substring({text}, 1, 1) not in ('{{', '[') and btrim({text}, {sql_text(UNICODE_SPACE)}) <> ''"
        found.append(
            f"case when {text} is null then null when {plain} then btrim({text}, {sql_text(CONTROL_SPACE)}) "
            f"else {_first_usable(sources)} end as _{name}"
        )
    return alerts.selectExpr("*", *present).selectExpr(*kept, *found)


def _or(name: str, default: str) -> Column:
    return F.expr(f"coalesce(_{name}, {default})")


def alert_id(payload_id: Column, index: Column) -> Column:
    """The document's id for its first alert, a hash of both numbers for the others."""
    return F.when(index > 0, F.xxhash64(payload_id, index)).otherwise(payload_id)


def normalize_alerts(payloads: DataFrame, as_of=None, mode: str = "first") -> DataFrame:
    """One incident candidate per alert; each field is the first non-blank of its ordered sources.

    `alert_id` tells the alerts of one document apart where documents have an id.
    """
    searched = "_search_name is not null"
    col = F.col
    kept = [c for c in payloads.columns if c != "payload"]
    fields = read_sources(explode_alerts(payloads, mode)).select(
        *kept,
        "payload",
        "alert_index",
        _or("alert_name", f"'{C.DEFAULT_ALERT_NAME}'").alias("alert_name"),
        _or("service_name", f"'{C.DEFAULT_SERVICE}'").alias("service_name"),
        F.coalesce(
            col("_severity_first"), A.severity_from_level(col("_level")), col("_severity_last"), F.lit(C.DEFAULT_SEVERITY)
        ).alias("severity"),
        _or("status", f"if({searched}, 'OPEN', 'firing')").alias("raw_status"),
        _or("source", f"if({searched}, 'splunk', 'grafana-webhook')").alias("source"),
        col("_trace_id").alias("trace_id"),
        F.coalesce(*[A.whole_number(col(f"_status_code_{i}")) for i in range(len(C.ALERT_STATUS_CODE))]).alias("status_code"),
        _or("failure_type", f"'{C.DEFAULT_FAILURE}'").alias("failure_type"),
        col("_error_message").alias("error_message"),
        F.coalesce(
            *[A.alert_datetime(col(f"_started_{i}")) for i in range(len(C.ALERT_STARTED))], instant(as_of)
        ).alias("created_at"),
        col("_raw_log").alias("raw_log"),
    )
    if "payload_id" in payloads.columns:
        fields = fields.withColumn("alert_id", alert_id(col("payload_id"), col("alert_index")))
    return (
        fields.withColumns(
            {
                "trace_id": F.coalesce(
                    col("trace_id"), F.concat(F.lit("incident-"), F.translate(F.lower("alert_name"), " ", "-"))
                ),
                "error_message": F.coalesce(col("error_message"), F.concat("alert_name", F.lit(" detected"))),
                "status": A.normalize_incident_status(col("raw_status")),
            }
        ).withColumn(
            "raw_log",
            F.coalesce(
                col("raw_log"),
                A.synthesize_raw_log(
                    A.log_level_of(col("severity")), col("created_at"), col("service_name"), col("trace_id"),
                    col("status_code"), col("failure_type"), col("error_message"),
                ),
            ),
        )
    )


def incident_columns(id_column: str = "alert_id", repeatable: bool = True) -> list[Column]:
    """The columns of an incident that waits for the parser, from those of its alert."""
    col = F.col
    key = col(id_column).cast("string") if repeatable else None
    return [
        col(id_column).alias("id"),
        col("alert_name"),
        col("alert_name").alias("title"),
        col("error_message").alias("description"),
        A.incident_number(col("service_name"), key).alias("incident_number"),
        col("service_name"), col("severity"), col("status"), col("source"),
        col("payload").alias("raw_payload"),
        col("raw_log"), col("trace_id"),
        F.lit("PENDING").alias("parser_status"),
        F.lit(C.PARSER_WAITING).alias("parser_message"),
        col("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("parsed_at"),
        col("created_at").alias("updated_at"),
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
        F.lit(None).cast("string").alias("notes"),
    ]


def build_incidents(alerts: DataFrame, id_column: str = "alert_id", repeatable: bool = True) -> DataFrame:
    """Incident rows waiting for the parser."""
    return alerts.select(*incident_columns(id_column, repeatable))


def parse_requests(alerts: DataFrame, id_column: str = "alert_id", **carried: Column) -> DataFrame:
    """What the log parser reads for each alert, and columns that pass through it."""
    return alerts.select(
        F.col(id_column).alias("incident_id"), "raw_log", "service_name",
        F.col("created_at").alias("timestamp"), "trace_id", "status_code", "failure_type", "error_message",
        *[value.alias(name) for name, value in carried.items()],
    )


def apply_parse_outcome(incidents: DataFrame, parsed: DataFrame, as_of=None, error: str | None = None) -> DataFrame:
    """Mark each incident COMPLETED with its parsed log, FAILED without one."""
    logs = parsed.select(F.col("incident_id").alias("_incident"), F.col("trace_id").alias("_trace"))
    joined = incidents.join(logs, incidents["id"] == logs["_incident"], "left")
    return _outcome(joined, F.col("_incident").isNotNull(), as_of, error).select(*incidents.columns)


def parsed_incidents(logs: DataFrame, as_of=None) -> DataFrame:
    """`apply_parse_outcome` for parsed logs that carry their incident as `incident`: one row each, so nothing is joined."""
    own = logs.select("incident.*", F.col("trace_id").alias("_trace"))
    return _outcome(own, F.lit(True), as_of, None).drop("_trace")


def _outcome(incidents: DataFrame, done: Column, as_of, error: str | None) -> DataFrame:
    now = instant(as_of)
    failed = F.concat(F.lit(C.PARSER_FAILED), A.summarize_text(F.lit(error).cast("string")))
    changes = {
        "parser_status": F.when(done, "COMPLETED").otherwise("FAILED"),
        "parser_message": F.when(done, F.lit(C.PARSER_DONE)).otherwise(failed),
        "parsed_at": F.when(done, now).otherwise(F.col("parsed_at")),
        "updated_at": now,
        "trace_id": F.when(~is_blank(F.col("_trace")), F.col("_trace")).otherwise(F.col("trace_id")),
    }
    return incidents.withColumns(changes)
