"""Keyed state over streams: counter growth, outages, rule state changes, notification groups.

State per key is one small row. Rows are aggregated per key and moment and wait for the watermark before they meet it, so a hot key sends
few rows, in order of time whatever the order of arrival.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from faultline import constants as C
from faultline.functions.labels import series_key
from faultline.operators.metrics import select_series
from faultline.operators.rules import down_rules

LATENESS = "5 minutes"


def _seconds(stamp) -> float:
    return pd.Timestamp(stamp).value / 1e9


def _stamp(seconds: float) -> pd.Timestamp:
    return pd.Timestamp(round(seconds * 1e6), unit="us")


def _sorted(rows, column: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(column, kind="stable")


class Increase(StatefulProcessor):
    """Growth of one series over the last steps at every step, from closed steps.

    A step arrives when the watermark has passed its end, so late samples are in it. State is the summaries of the
    steps that an evaluation can still reach; a timer at each evaluation time gives its result.
    """

    COLUMNS = ["series", "at", "value"]

    def __init__(self, step: float, spans: int):
        self.step, self.spans = step, spans

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = handle.getMapState("steps", "step bigint", "n bigint, growth double, joint double")
        self.last = handle.getValueState("last", "value double")

    def handleInputRows(self, key, rows, timerValues):
        batch = _sorted(rows, "step")
        before = self.last.get()[0] if self.last.exists() else None
        for step, n, first, final, growth in zip(batch["step"], batch["n"], batch["first"], batch["final"], batch["growth"]):
            joint = 0.0 if before is None else first if first < before else first - before
            self.steps.updateValue((int(step),), (int(n), float(growth), float(joint)))
            before = float(final)
            for at in range(int(step), int(step) + self.spans):
                self.handle.registerTimer(int(at * self.step * 1000))
        self.last.update((before,))
        yield pd.DataFrame([], columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at = round(expiredTimerInfo.getExpiryTimeInMs() / 1000.0 / self.step)
        kept = sorted((step, *value) for (step,), value in self.steps.iterator())
        inside = [row for row in kept if at - self.spans < row[0] <= at]
        found = []
        if sum(row[1] for row in inside) >= 2:
            value = sum(growth + joint for _, _, growth, joint in inside) - inside[0][3]
            found = [(key[0], at, value)] if value > 0 else []
        for row in kept:
            # The next evaluation starts one step later.
            if row[0] <= at - self.spans + 1:
                self.steps.removeKey((row[0],))
        yield pd.DataFrame(found, columns=self.COLUMNS)

    def close(self) -> None:
        pass


def counter_steps(samples: DataFrame, step: float, lateness: str) -> DataFrame:
    """One row per series and closed step (left-open, right-closed), whatever the order of arrival.

    Only the samples of one step and series meet, as many as the scrape interval lets into a step.
    """
    micros = round(step * 1_000_000)
    moved = samples.select(
        F.to_json(series_key(F.col("labels"))).alias("series"),
        (F.col("ts").cast("timestamp") - F.expr("interval 1 microsecond")).alias("moved"), "ts", "value",
    )
    grouped = moved.withWatermark("moved", lateness).groupBy("series", F.window("moved", f"{micros} microseconds")).agg(
        F.sort_array(F.collect_list(F.struct("ts", "value"))).alias("samples"))
    before = F.slice("samples", F.lit(1), F.size("samples") - 1)
    grown = F.zip_with(before, F.slice("samples", F.lit(2), F.size("samples") - 1), lambda a, b: F.when(
        b["value"] < a["value"], b["value"]).otherwise(b["value"] - a["value"]))
    return grouped.select(
        "series", "window", F.round(F.unix_micros("window.end") / micros).cast("bigint").alias("step"),
        F.size("samples").cast("bigint").alias("n"), F.element_at("samples", 1)["value"].alias("first"),
        F.element_at("samples", -1)["value"].alias("final"),
        F.aggregate(F.when(F.size("samples") > 1, grown).otherwise(F.array().cast("array<double>")), F.lit(0.0), lambda x, y: x + y).alias("growth"),
    )


def blocked_payment_alerts(samples: DataFrame, window: float = 120.0, step: float | None = None, lateness: str = LATENESS) -> DataFrame:
    """The batch rule over a stream: an alert per series at every evaluation with new 400 responses."""
    step = window if step is None else step
    spans = round(window / step)
    if spans * step != window:
        raise ValueError("the window must be a whole number of steps")
    series = select_series(samples, C.HTTP_COUNT, {"job": "payment-service", "status": "400"})
    firing = counter_steps(series, step, lateness).groupBy("series").transformWithStateInPandas(
        Increase(step, spans), "series string, at bigint, value double", "append", "eventTime"
    )
    text = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return firing.select(
        F.timestamp_micros((F.col("at") * round(step * 1_000_000)).cast("bigint")).cast("timestamp_ntz").alias("eval_ts"),
        "series", F.lit("firing").alias("status"), "value",
        text(C.BLOCKED_LABELS).alias("labels"), text(C.BLOCKED_ANNOTATIONS).alias("annotations"),
    )


class Outage(StatefulProcessor):
    """Outages of one job, from the stretches of down samples of closed windows.

    An outage is pending until a sample at least `pending` seconds behind its first one is down, then firing. It is
    reported once firing and once more, as resolved, when an up sample or `quiet` seconds without a sample end it. State
    is one row: first and last down sample, their number, and whether it fires. A batch is held as plain arrays of numbers.
    """

    COLUMNS = ["job", "status", "down_from", "down_to", "samples"]
    STRETCH = ["at", "last", "n", "fresh", "closed"]
    CHUNK = 10_000

    def __init__(self, pending: float, quiet: float, span: float):
        self.pending, self.quiet, self.span = pending, quiet, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.down = handle.getValueState("down", "since bigint, last bigint, n bigint, firing boolean")

    def _row(self, job: str, status: str, since: int, last: int | None, n: int | None) -> tuple:
        return (job, status, pd.Timestamp(since, unit="us"), None if last is None else pd.Timestamp(last, unit="us"), n)

    def _in_order(self, rows):
        """The stretches of a batch in order of time."""
        parts = [[pdf[name].to_numpy("int64") for name in self.STRETCH] for pdf in rows]
        columns = [np.concatenate(column) for column in zip(*parts)]
        order = np.argsort(columns[0], kind="stable")
        for i in range(0, len(order), self.CHUNK):
            chosen = order[i:i + self.CHUNK]
            yield from zip(*(column[chosen].tolist() for column in columns))

    def handleInputRows(self, key, rows, timerValues):
        since, last, n, firing = self.down.get() if self.down.exists() else (None, None, 0, False)
        found = []
        for at, end, count, fresh, closed in self._in_order(rows):
            if since is not None and (fresh or at - last > self.quiet * 1e6):
                if firing:
                    found.append(self._row(key[0], "resolved", since, last, n))
                since, last, n, firing = None, None, 0, False
            if not count:
                continue
            since, last, n = at if since is None else since, end, n + count
            if not firing and last - since >= self.pending * 1e6:
                firing = True
                found.append(self._row(key[0], "firing", since, None, None))
            if closed:
                if firing:
                    found.append(self._row(key[0], "resolved", since, last, n))
                since, last, n, firing = None, None, 0, False
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if since is None:
            self.down.clear()
        else:
            self.down.update((since, last, n, firing))
            # A sample within `quiet` may lie in a window that is still open, which closes at most `span` later.
            self.handle.registerTimer(int(last / 1000 + (self.quiet + self.span) * 1000) + 1)
        yield pd.DataFrame(found, columns=self.COLUMNS).astype({"samples": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        since, last, n, firing = self.down.get()
        self.down.clear()
        found = [self._row(key[0], "resolved", since, last, n)] if firing else []
        yield pd.DataFrame(found, columns=self.COLUMNS).astype({"samples": "Int64"})

    def close(self) -> None:
        pass


def down_stretches(samples: str, pending: float, quiet: float) -> Column:
    """The stretches of down samples of one window's sorted samples (at, down) that can belong to an outage that fires.

    Up samples and gaps above `quiet` end a stretch. Those inside the window that are shorter than `pending` cannot fire. A stretch
    is fresh if something inside the window ended what was before it, closed if something inside ended it. A window that leaves
    no stretch but begins up gives a row without samples, which ends what was before it.
    """
    col, micros = F.col, lambda seconds: F.lit(round(seconds * 1_000_000))
    whole = F.size(samples)
    near = lambda i: F.get(col(samples), i)
    apart = lambda a, b: (~a["down"]) | (~b["down"]) | (b["at"] - a["at"] > micros(quiet))
    placed = F.transform(samples, lambda x, i: F.struct(
        x["at"].alias("at"), x["down"].alias("down"), i.alias("i"),
        F.coalesce(apart(near(i - 1), x), F.lit(True)).alias("begins"), F.coalesce(apart(x, near(i + 1)), F.lit(True)).alias("ends")))
    kept = F.filter(placed, lambda x: x["down"] & (x["begins"] | x["ends"]))
    flag = lambda condition: condition.cast("bigint")
    stretches = F.zip_with(
        F.filter(kept, lambda x: x["begins"]), F.filter(kept, lambda x: x["ends"]),
        lambda a, b: F.struct(
            a["at"].alias("at"), b["at"].alias("last"), (b["i"] - a["i"] + 1).cast("bigint").alias("n"),
            flag(a["i"] > 0).alias("fresh"), flag(b["i"] < whole - 1).alias("closed")))
    able = F.filter(stretches, lambda s: (s["fresh"] == 0) | (s["closed"] == 0) | (s["last"] - s["at"] >= micros(pending)))
    first = near(F.lit(0))
    none = F.struct(first["at"].alias("at"), first["at"].alias("last"), F.lit(0).cast("bigint").alias("n"),
                    F.lit(1).cast("bigint").alias("fresh"), F.lit(1).cast("bigint").alias("closed"))
    return F.when(F.size(able) > 0, able).otherwise(F.array(none))


def service_down_alerts(
    samples: DataFrame, pending: float = 30.0, quiet: float = 86400.0, lateness: str = LATENESS
) -> DataFrame:
    """The batch rule over a stream: each outage of a watched service when it fires and when it is over.

    The columns are those of the batch rule and `status`; a firing row has no end yet. Samples of one job and window (`pending`
    seconds, a minute at most) are put in order and folded to stretches before they meet the state, and only behind the watermark, so late
    ones are in their place and the state meets a few rows per window, however many samples it has.
    """
    col, lit = F.col, F.lit
    span = max(1, min(60, int(pending)))
    jobs = [job for _, job, _ in C.DOWN_RULES]
    up = samples.filter(col("metric") == "up").select(
        col("labels")["job"].alias("job"), col("ts").cast("timestamp").alias("ts"), (col("value") == 0).alias("down")
    ).filter(col("job").isin(jobs))
    sample = F.struct(F.unix_micros("ts").alias("at"), "down")
    windows = up.withWatermark("ts", lateness).groupBy("job", F.window("ts", f"{span} seconds")).agg(
        F.sort_array(F.collect_list(sample)).alias("samples"))
    stretches = windows.select("job", "window", F.inline(down_stretches("samples", pending, quiet)))
    found = stretches.groupBy("job").transformWithStateInPandas(
        Outage(pending, quiet, span), "job string, status string, down_from timestamp_ntz, down_to timestamp_ntz, samples bigint",
        "append", "eventTime",
    )
    rule = F.filter(down_rules(), lambda item: item["job"] == col("job"))[0]
    fired = F.timestamp_micros(F.unix_micros(col("down_from").cast("timestamp")) + lit(round(pending * 1_000_000)))
    return found.select(
        "status", rule["alertname"].alias("alertname"), "job", "down_from", "down_to", "samples",
        fired.cast("timestamp_ntz").alias("fired_at"), rule["summary"].alias("summary"),
        F.concat(lit("Prometheus detected "), "job", lit(" as unavailable")).alias("description"),
    )


class Flip(StatefulProcessor):
    """Rows when a rule becomes active, and a timer that reports the end of its activity."""

    def __init__(self, every: float):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "run_at double")

    def handleInputRows(self, key, rows, timerValues):
        batch = _sorted(rows, "run_at")
        before = self.last.get()[0] if self.last.exists() else None
        found = []
        for stamp in batch["run_at"]:
            at = _seconds(stamp)
            if before is not None and at - before > self.every:
                found.append((key[0], "inactive", _stamp(before + self.every)))
                before = None
            if before is None:
                found.append((key[0], "active", _stamp(at)))
            before = at
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((before + self.every) * 1000))
        self.last.update((before,))
        yield pd.DataFrame(found, columns=["rule", "state", "changed_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        before = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame([(key[0], "inactive", _stamp(before + self.every))], columns=["rule", "state", "changed_at"])

    def close(self) -> None:
        pass


def on_state_change(active: DataFrame, every: float, lateness: str = LATENESS) -> DataFrame:
    """Notifications when a rule starts and stops, from its active runs.

    Runs of a rule are one row per time before they meet its state, and only behind the watermark."""
    runs = active.select("rule", F.col("run_at").cast("timestamp").alias("run_at")).withWatermark("run_at", lateness)
    once = runs.groupBy("rule", "run_at").agg(F.count("*").alias("n"))
    return once.groupBy("rule").transformWithStateInPandas(
        Flip(every), "rule string, state string, changed_at timestamp_ntz", "append", "eventTime"
    )


class Notifier(StatefulProcessor):
    """First notification after a wait, changes on a beat, repeats while the group lives.

    Beat b of a group is at start + wait + b * interval. State: start, newest alert and last sent beat of
    the group, and the alerts counted per beat that is still to come.
    """

    COLUMNS = ["group", "sent_at", "kind", "new_alerts"]

    def __init__(self, wait: float, interval: float, repeat: float, lifetime: float):
        self.wait, self.interval, self.lifetime = wait, interval, lifetime
        self.every = max(1, math.ceil(repeat / interval))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.group = handle.getValueState("group", "start double, seen double, sent bigint")
        self.waiting = handle.getMapState("waiting", "beat bigint", "count bigint")

    def _time(self, start: float, beat: int) -> float:
        return start + self.wait + beat * self.interval

    def _following(self, start: float, seen: float, sent: int | None, waiting: dict) -> int | None:
        """The next beat with a notification, None when the group has no more."""
        last = math.floor((seen + self.lifetime - start - self.wait) / self.interval)
        again = None if sent is None or sent + self.every > last else sent + self.every
        return min((beat for beat in [min(waiting, default=None), again] if beat is not None), default=None)

    def _send(self, group: str, start: float, seen: float, sent: int | None, waiting: dict, until: float):
        """Notifications due by `until`, and the last sent beat after them."""
        found = []
        while (beat := self._following(start, seen, sent, waiting)) is not None and self._time(start, beat) <= until:
            count = waiting.pop(beat, 0)
            kind = "repeat" if count == 0 else "first" if sent is None else "change"
            found.append((group, _stamp(self._time(start, beat)), kind, count))
            sent = beat
        return found, sent

    def _load(self):
        start, seen, sent = self.group.get() if self.group.exists() else (None, None, None)
        return start, seen, sent, {beat: count for (beat,), (count,) in self.waiting.iterator()}

    def _keep(self, start: float, seen: float, sent: int | None, waiting: dict) -> None:
        self.group.update((start, seen, sent))
        self.waiting.clear()
        for beat, count in waiting.items():
            self.waiting.updateValue((beat,), (count,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        beat = self._following(start, seen, sent, waiting)
        at = seen + self.lifetime if beat is None else min(self._time(start, beat), seen + self.lifetime)
        self.handle.registerTimer(math.ceil(at * 1000) + 1)

    def handleInputRows(self, key, rows, timerValues):
        start, seen, sent, waiting = self._load()
        found = []
        batch = _sorted(rows, "ts")
        for stamp, count in zip(batch["ts"], batch["n"]):
            at = _seconds(stamp)
            if start is not None and at - seen > self.lifetime:
                found += self._send(key[0], start, seen, sent, waiting, math.inf)[0]
                start, sent = None, None
            start = at if start is None else start
            seen = at
            beat = max(0, math.ceil((at - start - self.wait) / self.interval))
            waiting[beat] = waiting.get(beat, 0) + int(count)
        self._keep(start, seen, sent, waiting)
        yield pd.DataFrame(found, columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        start, seen, sent, waiting = self._load()
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000.0
        over = timerValues.getCurrentWatermarkInMs() / 1000.0 > seen + self.lifetime
        found, sent = self._send(key[0], start, seen, sent, waiting, math.inf if over else now)
        if over:
            self.group.clear()
            self.waiting.clear()
        else:
            self._keep(start, seen, sent, waiting)
        yield pd.DataFrame(found, columns=self.COLUMNS)

    def close(self) -> None:
        pass


def group_notifications(
    alerts: DataFrame,
    key: str,
    wait: float = 10.0,
    interval: float = 30.0,
    repeat: float = 3600.0,
    lifetime: float = 300.0,
    lateness: str = LATENESS,
) -> DataFrame:
    """Notifications of one alert group per key, driven by event-time timers.

    Alerts of a group are counted per time before they meet its state, and only behind the watermark."""
    rows = alerts.select(F.col(key).alias("group"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", lateness)
    counted = rows.groupBy("group", "ts").agg(F.count("*").alias("n"))
    return counted.groupBy("group").transformWithStateInPandas(
        Notifier(wait, interval, repeat, lifetime),
        "group string, sent_at timestamp_ntz, kind string, new_alerts bigint", "append", "eventTime",
    )
