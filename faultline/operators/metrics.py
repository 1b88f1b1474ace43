"""Metric samples: counters, rates, label aggregates and the service dashboards."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions.labels import match_labels, rename_label, series_key
from faultline.functions.text import epoch_seconds, from_epoch_seconds
from faultline.operators.keyed import vector_divide, vector_or

MB = 1024 * 1024


def select_series(
    samples: DataFrame, metric: str, equal: dict | None = None, regex: dict | None = None
) -> DataFrame:
    return samples.filter((F.col("metric") == metric) & match_labels(F.col("labels"), equal, regex))


def value_compare(samples: DataFrame, condition: str, bound: float) -> DataFrame:
    """Keep samples whose value compares to a bound: ==, >, <, >=, <=, !=."""
    value = F.col("value")
    compared = {
        "==": value == bound, "!=": value != bound, ">": value > bound,
        "<": value < bound, ">=": value >= bound, "<=": value <= bound,
    }
    return samples.filter(compared[condition])


def _grow(value: Column, previous: Column) -> Column:
    """Growth of a counter; a drop is a restart from 0."""
    return F.when(previous.isNull(), 0.0).when(value < previous, value).otherwise(value - previous)


def counter_steps(samples: DataFrame, step: float) -> DataFrame:
    """One row per series and step (left-open, right-closed): first and last sample and growth inside.

    Samples are sorted per series and step, so a long or hot series spreads over many tasks.
    """
    keyed = samples.withColumns(
        {"series": series_key(F.col("labels")), "step": F.ceil(epoch_seconds(F.col("ts")) / step)}
    )
    inside = Window.partitionBy("metric", "series", "step").orderBy("ts")
    grown = keyed.withColumn("growth", _grow(F.col("value"), F.lag("value").over(inside)))
    steps = grown.groupBy("metric", "series", "step").agg(
        F.count("*").alias("n"),
        F.min("ts").alias("first_ts"), F.min_by("value", "ts").alias("first_value"),
        F.max("ts").alias("last_ts"), F.max_by("value", "ts").alias("last_value"),
        F.sum("growth").alias("growth"),
    )
    along = Window.partitionBy("metric", "series").orderBy("step")
    return steps.withColumn("joint", _grow(F.col("first_value"), F.lag("last_value").over(along)))


def counter_increase(
    samples: DataFrame, window: float, step: float | None = None, extrapolate: bool = False
) -> DataFrame:
    """Reset-corrected growth over (t - window, t] at every step; below two samples no row.

    `extrapolate` stretches the growth to the window edges as the public rate definition does.
    """
    step = window if step is None else step
    spans = round(window / step)
    if spans * step != window:
        raise ValueError("the window must be a whole number of steps")
    col = F.col
    steps = counter_steps(samples, step).withColumn(
        "at", F.explode(F.sequence(col("step"), col("step") + F.lit(spans - 1)))
    )
    total = F.sum(col("growth") + col("joint")) - F.min_by("joint", "step")
    ranges = (
        steps.groupBy("metric", "series", "at")
        .agg(
            F.sum("n").alias("n"), total.alias("value"),
            F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
            F.min_by("first_value", "step").alias("first_value"),
        )
        .filter(col("n") >= 2)
    )
    if extrapolate:
        ranges = ranges.withColumn("value", col("value") * _stretch(window, step))
    return ranges.select(
        from_epoch_seconds(col("at") * F.lit(float(step))).alias("eval_ts"),
        "metric", F.map_from_entries("series").alias("labels"), "value",
    )


def _stretch(window: float, step: float) -> Column:
    """How far the sampled interval reaches when extended to the window edges.

    An edge farther than 1.1 mean gaps gets half a gap; a counter is never extended below 0.
    """
    col = F.col
    first, last = epoch_seconds(col("first_ts")), epoch_seconds(col("last_ts"))
    end = col("at") * F.lit(float(step))
    sampled = last - first
    gap = sampled / (col("n") - 1)
    near = gap * 1.1
    to_start = first - (end - window)
    to_start = F.when(to_start >= near, gap / 2).otherwise(to_start)
    to_zero = F.when((col("value") > 0) & (col("first_value") >= 0), sampled * col("first_value") / col("value"))
    to_start = F.least(to_start, F.coalesce(to_zero, to_start))
    to_end = end - last
    to_end = F.when(to_end >= near, gap / 2).otherwise(to_end)
    return F.coalesce(F.try_divide(sampled + to_start + to_end, sampled), F.lit(1.0))


def counter_rate(samples: DataFrame, window: float, step: float | None = None, extrapolate: bool = False) -> DataFrame:
    """Growth per second."""
    grown = counter_increase(samples, window, step, extrapolate)
    return grown.withColumn("value", F.col("value") / F.lit(float(window)))


def _label_columns(names: list[str]) -> list[Column]:
    return [F.coalesce(F.col("labels")[name], F.lit("")).alias(name) for name in names]


def sum_by(vector: DataFrame, labels: list[str], time: str = "eval_ts") -> DataFrame:
    return vector.groupBy(time, *_label_columns(labels)).agg(F.sum("value").alias("value"))


def avg_by(vector: DataFrame, labels: list[str], time: str = "eval_ts") -> DataFrame:
    return vector.groupBy(time, *_label_columns(labels)).agg(F.avg("value").alias("value"))


def last_not_null(samples: DataFrame, keys: list, time: str = "ts") -> DataFrame:
    """Newest non-null value per key."""
    newest = F.max_by("value", F.when(F.col("value").isNotNull(), F.col(time)))
    return samples.groupBy(*keys).agg(newest.alias("value"))


# --- dashboards -------------------------------------------------------------------------------------------

class Rates:
    """Rate panels over one window and step."""

    def __init__(self, samples: DataFrame, window: float, step: float | None = None, extrapolate: bool = False):
        self.samples, self.options = samples, (window, step, extrapolate)

    def by(self, metric: str, labels: list[str], equal=None, regex=None, rename=None) -> DataFrame:
        vector = counter_rate(select_series(self.samples, metric, equal, regex), *self.options)
        if rename:
            vector = vector.withColumn("labels", rename_label(F.col("labels"), *rename))
        return sum_by(vector, labels)

    def throughput_by_service(self) -> DataFrame:
        return vector_or(
            self.by(C.HTTP_COUNT, ["job"], regex={"job": C.HTTP_JOBS}),
            self.by(C.GATEWAY_COUNT, ["job"], equal={"job": C.GATEWAY_JOB}),
            ["eval_ts", "job"],
        )

    def error_rate(self) -> DataFrame:
        return vector_or(
            self.by(C.HTTP_COUNT, ["job"], regex={"job": C.HTTP_JOBS, "status": C.ERROR_STATUS}),
            self.by(
                C.GATEWAY_COUNT, ["job"], equal={"job": C.GATEWAY_JOB}, regex={"httpStatusCode": C.ERROR_STATUS}
            ),
            ["eval_ts", "job"],
        )

    def requests_by_status(self) -> DataFrame:
        return vector_or(
            self.by(C.HTTP_COUNT, ["job", "status"], regex={"job": C.HTTP_JOBS}),
            self.by(
                C.GATEWAY_COUNT, ["job", "status"], equal={"job": C.GATEWAY_JOB},
                rename=("httpStatusCode", "status"),
            ),
            ["eval_ts", "job", "status"],
        )

    def latency(self, sums: str, counts: str, equal=None, regex=None) -> DataFrame:
        above, below = (self.by(metric, ["job"], equal, regex) for metric in (sums, counts))
        ratio = vector_divide(
            above.withColumn("value", F.col("value") * 1000), below, ["eval_ts", "job"], floor=0.001
        )
        return ratio

    def avg_response_ms(self) -> DataFrame:
        return vector_or(
            self.latency(C.HTTP_SUM, C.HTTP_COUNT, regex={"job": C.HTTP_JOBS}),
            self.latency(C.GATEWAY_SUM, C.GATEWAY_COUNT, equal={"job": C.GATEWAY_JOB}),
            ["eval_ts", "job"],
        )

    def user_traffic(self) -> DataFrame:
        return self.by(
            C.HTTP_COUNT, ["uri", "status"], equal={"job": "user-service"}, regex={"uri": C.USER_BATCH_URIS}
        )

    def money_traffic(self) -> DataFrame:
        return self.by(C.HTTP_COUNT, ["job", "status"], regex={"job": C.MONEY_JOBS, "uri": C.MONEY_URIS})

    def money_latency(self) -> DataFrame:
        return self.latency(C.HTTP_SUM, C.HTTP_COUNT, regex={"job": C.MONEY_JOBS, "uri": C.MONEY_URIS})

    def gateway_traffic(self) -> DataFrame:
        return self.by(C.GATEWAY_COUNT, ["routeId", "httpStatusCode"], equal={"job": C.GATEWAY_JOB})


def availability(samples: DataFrame, jobs: str = C.ALL_JOBS) -> DataFrame:
    """Newest `up` value per job as Up or Down."""
    last = last_not_null(
        select_series(samples, "up", regex={"job": jobs}), [F.col("labels")["job"].alias("job")]
    )
    return last.withColumn("state", F.when(F.col("value") == 0, "Down").when(F.col("value") == 1, "Up"))


def uptime_minutes(samples: DataFrame, job: str = C.GENERATOR_JOB) -> DataFrame:
    own = select_series(samples, "process_uptime_seconds", {"job": job})
    return own.select("ts", F.col("labels")["job"].alias("job"), (F.col("value") / 60).alias("value"))


def at_steps(samples: DataFrame, step: float) -> DataFrame:
    """Instant vectors: the newest sample of each series in each step."""
    keyed = samples.withColumns(
        {"series": series_key(F.col("labels")), "at": F.ceil(epoch_seconds(F.col("ts")) / step)}
    )
    last = keyed.groupBy("metric", "series", "at").agg(F.max_by("value", "ts").alias("value"))
    return last.select(
        from_epoch_seconds(F.col("at") * F.lit(float(step))).alias("eval_ts"),
        "metric", F.map_from_entries("series").alias("labels"), "value",
    )


def heap_used_mb(samples: DataFrame, step: float, jobs: str = C.ALL_JOBS) -> DataFrame:
    used = select_series(samples, "jvm_memory_used_bytes", {"area": "heap"}, {"job": jobs})
    return sum_by(at_steps(used, step), ["job"]).withColumn("value", F.col("value") / MB)


def cpu_percent(samples: DataFrame, step: float, jobs: str = C.ALL_JOBS) -> DataFrame:
    usage = select_series(samples, "process_cpu_usage", regex={"job": jobs})
    return avg_by(at_steps(usage, step), ["job"]).withColumn("value", F.col("value") * 100)


def live_threads(samples: DataFrame, step: float, jobs: str = C.ALL_JOBS) -> DataFrame:
    threads = select_series(samples, "jvm_threads_live_threads", regex={"job": jobs})
    return avg_by(at_steps(threads, step), ["job"])
