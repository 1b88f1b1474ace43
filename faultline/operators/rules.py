"""Alert rules over logs and metrics, alert payloads, routing and notification groups."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions.labels import contains_text, has_phrase
from faultline.functions.text import epoch_seconds, from_epoch_seconds, instant, seconds_between
from faultline.operators.metrics import counter_increase, select_series
from faultline.operators.segments import runs, time_segment

EVENT_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _text_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(item) for pair in values.items() for item in pair])


# --- metric rules -----------------------------------------------------------------------------------------

def blocked_payment_alerts(samples: DataFrame, window: float = 120.0, step: float | None = None) -> DataFrame:
    """An alert at every evaluation with new 400 responses of the payment service."""
    series = select_series(samples, C.HTTP_COUNT, {"job": "payment-service", "status": "400"})
    firing = counter_increase(series, window, step).filter(F.col("value") > 0)
    return firing.select(
        "eval_ts", F.lit("firing").alias("status"), "value",
        _text_map(C.BLOCKED_LABELS).alias("labels"),
        _text_map(C.BLOCKED_ANNOTATIONS).alias("annotations"),
    )


def down_rules() -> Column:
    """Fixed rules as (name, job, summary) rows."""
    return F.array(
        *[
            F.struct(F.lit(name).alias("alertname"), F.lit(job).alias("job"), F.lit(summary).alias("summary"))
            for name, job, summary in C.DOWN_RULES
        ]
    )


def down_periods(samples: DataFrame, segment_seconds: float = 3600.0) -> DataFrame:
    """Unbroken stretches of `up == 0` per job.

    Samples of one job are sorted in time segments, and a long outage is reduced before the shuffle.
    """
    up = samples.filter(F.col("metric") == "up").select(
        F.col("labels")["job"].alias("job"), "ts", (F.col("value") == 0).alias("down")
    )
    numbered = runs(up, ["job"], ["ts"], time_segment("ts", segment_seconds), "down")
    return (
        numbered.filter("down")
        .groupBy("job", "run")
        .agg(F.min("ts").alias("down_from"), F.max("ts").alias("down_to"), F.count("*").alias("samples"))
        .drop("run")
    )


def service_down_alerts(samples: DataFrame, pending: float = 30.0, segment_seconds: float = 3600.0) -> DataFrame:
    """An alert for every outage of a watched service that lasts at least the pending time."""
    col = F.col
    periods = down_periods(samples, segment_seconds)
    rule = F.filter(down_rules(), lambda item: item["job"] == col("job"))[0]
    long = periods.filter(seconds_between(col("down_from"), col("down_to")) >= pending)
    return (
        long.filter(col("job").isin([job for _, job, _ in C.DOWN_RULES]))
        .withColumn("rule", rule)
        .select(
            col("rule.alertname").alias("alertname"), "job", "down_from", "down_to", "samples",
            from_epoch_seconds(epoch_seconds(col("down_from")) + F.lit(pending)).alias("fired_at"),
            col("rule.summary").alias("summary"),
            F.concat(F.lit("Prometheus detected "), "job", F.lit(" as unavailable")).alias("description"),
        )
    )


def no_data_state(
    samples: DataFrame, jobs: list[str], as_of, lookback: float, no_data: str = "NoData", on_error: str = "Alerting"
) -> DataFrame:
    """State of each expected job: NoData without samples in the lookback, Alerting when down, else OK.

    A newest sample without a number is an evaluation error and gives `on_error`.
    """
    now = instant(as_of)
    age = seconds_between(F.col("ts"), now)
    recent = samples.filter((F.col("metric") == "up") & (age >= 0) & (age < lookback))
    last = recent.groupBy(F.col("labels")["job"].alias("job")).agg(
        F.max_by("value", "ts").alias("value"), F.lit(True).alias("seen")
    )
    names = F.explode(F.array(*[F.lit(job) for job in jobs]))
    expected = samples.sparkSession.range(1).select(names.alias("job"))
    value = F.col("value")
    state = (
        F.when(F.col("seen").isNull(), no_data)
        .when(value.isNull() | F.isnan(value), on_error)
        .when(value < 1, "Alerting")
        .otherwise("OK")
    )
    return expected.join(last, "job", "left").select("job", state.alias("state"))


# --- log rules --------------------------------------------------------------------------------------------

def matched_rules(message: Column, level: Column, rules=C.LOG_RULES) -> Column:
    """Names of all rules a log matches, found in one pass over the log."""
    hits = []
    for name, words, level_name in rules:
        hit = has_phrase(message, words)
        if level_name is not None:
            hit = hit | F.coalesce(F.upper(level) == level_name, F.lit(False))
        hits.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*hits))


def log_rule_hits(logs: DataFrame, rules=C.LOG_RULES) -> DataFrame:
    return logs.withColumn("rule", F.explode(matched_rules(F.col("message"), F.col("level"), rules)))


def count_in_window(rows: DataFrame, keys: list[str], length: str, slide: str | None = None, time: str = "ts") -> DataFrame:
    """Row counts per key and window, named by the window's end."""
    span = F.window(time, length, slide) if slide else F.window(time, length)
    counted = rows.groupBy(*keys, span.alias("window")).agg(F.count("*").alias("hits"))
    return counted.select(*keys, F.col("window.end").alias("run_at"), "hits")


def log_pattern_alerts(
    logs: DataFrame,
    length: str = "5 minutes",
    slide: str = "1 minute",
    threshold: int = 0,
    rules=C.LOG_RULES,
    exclude_previous_hits: bool = False,
) -> DataFrame:
    """Rules with more hits than the threshold, per scheduled run.

    With `exclude_previous_hits` a hit counts in the first run that sees it only.
    """
    hits = log_rule_hits(logs, rules)
    counted = count_in_window(hits, ["rule"], *([slide] if exclude_previous_hits else [length, slide]))
    return counted.filter(F.col("hits") > threshold)


def on_state_change(active: DataFrame, every: float, keys: list[str] = ["rule"]) -> DataFrame:
    """Notifications when a rule becomes active and when it stops, from its active runs.

    One row per rule and run comes in, already counted, so the window is short.
    """
    order = Window.partitionBy(*keys).orderBy("run_at")
    marked = active.withColumns(
        {"_before": F.lag("run_at").over(order), "_after": F.lead("run_at").over(order)}
    )
    starts = F.col("_before").isNull() | (seconds_between(F.col("_before"), F.col("run_at")) > every)
    ends = F.col("_after").isNull() | (seconds_between(F.col("run_at"), F.col("_after")) > every)
    stopped = from_epoch_seconds(epoch_seconds(F.col("run_at")) + F.lit(every))
    flips = F.array_compact(
        F.array(
            F.when(starts, F.struct(F.lit("active").alias("state"), F.col("run_at").alias("changed_at"))),
            F.when(ends, F.struct(F.lit("inactive").alias("state"), stopped.alias("changed_at"))),
        )
    )
    return marked.select(*keys, F.explode(flips).alias("flip")).select(*keys, "flip.*")


def latest_event(rows: DataFrame, time: str = "ts") -> DataFrame:
    return rows.orderBy(F.col(time).desc()).limit(1)


def login_failure_alerts(logs: DataFrame, length: str = "1 minute", phrase: str = C.LOGIN_PHRASE) -> DataFrame:
    """The newest failed login of each window as an alert row."""
    col, lit = F.col, F.lit
    found = logs.filter(contains_text(col("message"), phrase))
    newest = F.max_by(F.struct("ts", "service_name", "level", "message"), "ts").alias("event")
    rows = found.groupBy(F.window("ts", length).alias("window")).agg(newest)
    starts = F.date_format("event.ts", EVENT_TIME)
    blank = lit("")
    rows = rows.select(
        col("window.end").alias("run_at"),
        lit(C.LOGIN_ALERT).alias("alertName"),
        F.coalesce("event.service_name", lit(C.GENERATOR_JOB)).alias("serviceName"),
        F.when(col("event.level") == "ERROR", "critical").otherwise("warning").alias("severity"),
        lit("OPEN").alias("status"),
        lit("splunk").alias("source"),
        F.md5(
            F.concat(
                F.coalesce("event.service_name", blank), lit(":"), F.coalesce("event.message", blank),
                lit(":"), F.coalesce(starts, blank),
            )
        ).alias("traceId"),
        lit(C.LOGIN_STATUS).alias("statusCode"),
        lit(C.LOGIN_FAILURE).alias("failureType"),
        col("event.message").alias("errorMessage"),
        starts.alias("startsAt"),
        col("event.level").alias("level"),
    )
    raw = F.concat(
        "startsAt", lit(" "), "level", lit(" service="), "serviceName", lit(" traceId="), "traceId",
        lit(" status="), col("statusCode").cast("string"), lit(" failure="), "failureType",
        lit(" java.lang.IllegalStateException: "), "errorMessage",
    )
    return rows.withColumn("rawLog", raw).drop("level")


# --- payloads, routing, notification groups ---------------------------------------------------------------

def build_alert_payload(alerts: DataFrame, id_column: str | None = None) -> DataFrame:
    """Alert rows (status, eval_ts, labels, annotations) as webhook documents that normalisation reads."""
    started = F.date_format("eval_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    alert = F.struct("status", started.alias("startsAt"), "labels", "annotations")
    document = F.to_json(F.struct(F.lit(C.RECEIVER).alias("receiver"), F.array(alert).alias("alerts")))
    key = [F.col(id_column).alias("payload_id")] if id_column else []
    return alerts.select(*key, document.alias("payload"), F.col("eval_ts").alias("received_at"))


def search_result_payload(alerts: DataFrame, id_column: str | None = None) -> DataFrame:
    """Search alert rows as `result` documents."""
    fields = [c for c in alerts.columns if c not in ("run_at", id_column)]
    document = F.to_json(
        F.struct(F.col("alertName").alias("search_name"), F.struct(*fields).alias("result"))
    )
    key = [F.col(id_column).alias("payload_id")] if id_column else []
    return alerts.select(*key, document.alias("payload"), F.col("run_at").alias("received_at"))


def route_alerts(alerts: DataFrame, routes: list[tuple[dict, str]], default: str) -> DataFrame:
    """Receiver of the first route whose labels all match, else the default."""
    receiver = F.lit(default)
    for labels, name in reversed(routes):
        hit = reduce(lambda a, b: a & b, [F.coalesce(F.col("labels")[k] == v, F.lit(False)) for k, v in labels.items()])
        receiver = F.when(hit, F.lit(name)).otherwise(receiver)
    return alerts.withColumn("receiver", receiver)


def group_notifications(
    alerts: DataFrame,
    keys: list[str],
    time: str = "ts",
    wait: float = 10.0,
    interval: float = 30.0,
    repeat: float = 3600.0,
    lifetime: float = 300.0,
) -> DataFrame:
    """Notifications per alert group: first after `wait`, changes on an `interval` beat, repeats after `repeat`.

    A group lives until `lifetime` passes without an alert; the next alert starts a new group life.
    Alerts are counted per group and interval first, so a noisy group is small before it is ordered.
    """
    if lifetime < interval:
        raise ValueError("a group must outlive one interval")
    col = F.col
    moments = (
        alerts.groupBy(*keys, epoch_seconds(col(time)).alias("_second"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_slot", F.floor(col("_second") / interval))
    )
    slots = moments.groupBy(*keys, "_slot").agg(F.min("_second").alias("_from"), F.max("_second").alias("_to"))
    order = Window.partitionBy(*keys).orderBy("_slot")
    gap = col("_from") - F.lag("_to").over(order)
    fresh = (gap.isNull() | (gap > lifetime)).cast("bigint")
    lives = slots.withColumn("_fresh", fresh).withColumn("_life", F.sum("_fresh").over(order))
    whole = Window.partitionBy(*keys, "_life")
    lives = lives.select(
        *keys, "_slot", "_life",
        F.min("_from").over(whole).alias("_start"), F.max("_to").over(whole).alias("_end"),
    )
    late = (col("_second") - col("_start") - wait) / interval
    beats = (
        moments.join(lives, [*keys, "_slot"])
        .groupBy(*keys, "_life", "_start", "_end", F.greatest(F.lit(0), F.ceil(late)).cast("bigint").alias("_beat"))
        .agg(F.sum("_n").alias("new_alerts"))
    )
    along = Window.partitionBy(*keys, "_life").orderBy("_beat")
    every = F.greatest(F.lit(1), F.ceil(F.lit(repeat / interval))).cast("bigint")
    last = F.floor((col("_end") + lifetime - col("_start") - wait) / interval).cast("bigint")
    until = F.coalesce(F.lead("_beat").over(along) - 1, F.greatest(last, col("_beat")))
    sent = beats.withColumn("_until", until).withColumn(
        "_at", F.explode(F.sequence(col("_beat"), F.greatest(col("_until"), col("_beat")), every))
    )
    kind = F.when(col("_at") > col("_beat"), "repeat").when(col("_beat") == 0, "first").otherwise("change")
    return sent.select(
        *keys,
        from_epoch_seconds(col("_start") + wait + col("_at") * interval).alias("sent_at"),
        kind.alias("kind"),
        F.when(col("_at") == col("_beat"), col("new_alerts")).otherwise(0).cast("bigint").alias("new_alerts"),
    )
