"""Alert rules in batch: thresholds, suppression, resolution, escalation, rate limits, health alerts, channels."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Tables of at most so many rows are broadcast.
SMALL = 10_000


def _small(df: DataFrame, bound: int) -> bool:
    return df.limit(bound + 1).count() <= bound


def long_form(wide: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(key, metric, value) of a wide metric row."""
    return wide.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([key], metrics, "metric", "value").where("value is not null")


def breached(value: Column, limit: Column, below: Column) -> Column:
    return F.when(below, value < limit).otherwise(value > limit)


def threshold_alerts(samples: DataFrame, thresholds: DataFrame, bound: int = SMALL) -> DataFrame:
    """(ts, metric, value, severity, limit): samples (ts, metric, value) beyond their metric's limits (warning, critical, direction). Up to `bound` rules are broadcast."""
    below = F.col("direction") == "below"
    joined = samples.join(F.broadcast(thresholds) if _small(thresholds, bound) else thresholds, "metric")
    severity = F.when(breached(F.col("value"), F.col("critical"), below), "critical").when(breached(F.col("value"), F.col("warning"), below), "warning")
    found = joined.withColumn("severity", severity).where("severity is not null")
    return found.withColumn("limit", F.when(F.col("severity") == "critical", F.col("critical")).otherwise(F.col("warning"))).select(*samples.columns, "severity", "limit")


def _slot(moment: Column, seconds: float) -> Column:
    """The number of the span of so many seconds that holds a moment."""
    return F.floor(F.unix_micros(moment.cast("timestamp")) / F.lit(int(seconds * 1e6))).cast("long")


def suppressed(alerts: DataFrame, active: DataFrame, seconds: float) -> DataFrame:
    """Alerts (ts, metric, ..) without an active one (ts, metric) of their metric in the time before.

    Joined by metric and span of that time, in which an active alert and the span after it count, so a metric isn't one task's.
    """
    old = active.select(F.col("ts").alias("_ts"), F.col("metric").alias("_metric"), F.explode(F.array(_slot(F.col("ts"), seconds), _slot(F.col("ts"), seconds) + 1)).alias("_slot"))
    recent = (F.col("_ts") <= F.col("ts")) & (F.unix_micros(F.col("_ts").cast("timestamp")) > F.unix_micros(F.col("ts").cast("timestamp")) - int(seconds * 1e6))
    return alerts.join(old, (F.col("metric") == F.col("_metric")) & (_slot(F.col("ts"), seconds) == F.col("_slot")) & recent, "left_anti")


def as_of_join(rows: DataFrame, versions: DataFrame, key: str, moment: str, columns: list[str], seconds: float = 86_400) -> DataFrame:
    """rows with the columns of the last version of their key at or before their moment: no range join.

    A key's rows are ordered span by span; what was last before a span is carried into it from a table of spans, so a key
    isn't one task's.
    """
    marked = rows.withColumn("_v", F.lit(None).cast(versions.select(F.struct(*columns).alias("s")).schema["s"].dataType)).withColumn("_is", F.lit(1))
    other = [c for c in rows.columns if c not in (key, moment)]
    tagged = versions.select(key, moment, *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in other], F.struct(*columns).alias("_v"), F.lit(0).alias("_is"))
    both = marked.select(key, moment, *other, "_v", "_is").unionByName(tagged).withColumn("_slot", _slot(F.col(moment), seconds))
    version = F.col("_is") == 0
    spans = both.groupBy(F.col(key).alias("_k"), F.col("_slot").alias("_s")).agg(F.max_by(F.when(version, F.col("_v")), F.when(version, F.col(moment))).alias("_own"))
    earlier = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # a row a span
    carried = spans.select("_k", "_s", F.last("_own", ignorenulls=True).over(earlier).alias("_carried"))
    joined = both.join(carried, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_slot") == F.col("_s")))
    order = Window.partitionBy(key, "_slot").orderBy(moment, "_is").rowsBetween(Window.unboundedPreceding, 0)
    found = joined.withColumn("_last", F.coalesce(F.last("_v", ignorenulls=True).over(order), "_carried")).where("_is = 1")
    return found.select(*rows.columns, *[F.col(f"_last.{c}").alias(f"last_{c}") for c in columns])


def resolve_back(alerts: DataFrame, samples: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Active alerts (id, ts, metric, limit) older than `minutes` whose metric's latest sample is back under the limit: resolved."""
    latest = samples.groupBy("metric").agg(F.max_by("value", "ts").alias("latest"))
    joined = alerts.join(latest, "metric", "left")
    back = (F.col("ts") <= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))) & F.coalesce(F.col("latest") <= F.col("limit"), F.lit(False))
    return joined.withColumn("resolved", back)


def matching(alerts: DataFrame, rules: DataFrame, pairs: dict[str, str], bound: int = SMALL) -> DataFrame:
    """Alerts with rules whose arrays hold the alert's value, for each (alert column, rule array); a null array holds all.

    Up to `bound` rules are broadcast. More are joined by the values of their first array that isn't null; those without any go to every alert.
    """
    condition = F.lit(True)
    for column, array in pairs.items():
        condition = condition & (rules[array].isNull() | F.array_contains(rules[array], alerts[column]))
    if _small(rules, bound):
        return alerts.join(F.broadcast(rules), condition)
    rest, out = rules, None
    for column, array in pairs.items():
        keyed = rest.where(rules[array].isNotNull()).select("*", F.explode(F.array_distinct(rules[array])).alias("_v"))
        joined = alerts.join(keyed, (alerts[column] == F.col("_v")) & condition).drop("_v")
        out = joined if out is None else out.union(joined)
        rest = rest.where(rules[array].isNull())
    product = alerts.crossJoin(rest)
    return product if out is None else out.union(product)


def escalations(alerts: DataFrame, now: Column, delay: int, history: DataFrame) -> DataFrame:
    """(id, level): active alerts older than the delay, at 1, 2 or 3 times the delay, not yet told of at that level."""
    minutes = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 60.0
    level = F.when(minutes >= 3 * delay, 3).when(minutes >= 2 * delay, 2).when(minutes >= delay, 1)
    return alerts.select("id", level.alias("level")).where("level is not null").join(history.select("id", "level"), ["id", "level"], "left_anti")


def window_limit(requests: DataFrame, keys: list[str], moment: str, most: int, minutes: int, tie: str) -> DataFrame:
    """requests with allowed: the first `most` of each fixed window; later ones are blocked to the window's end."""
    slot = F.window(F.col(moment).cast("timestamp"), f"{minutes} minutes")
    order = Window.partitionBy(*keys, "_slot").orderBy(moment, tie)
    return requests.withColumn("_slot", slot["start"]).withColumn("allowed", F.row_number().over(order) <= most).drop("_slot")


def trailing_limit(requests: DataFrame, keys: list[str], moment: str, most: int, seconds: int) -> DataFrame:
    """requests with before (how many of the key came in the trailing time) and allowed."""
    order = Window.partitionBy(*keys).orderBy(F.unix_timestamp(F.col(moment).cast("timestamp"))).rangeBetween(-seconds, -1)
    counted = requests.withColumn("before", F.count("*").over(order))
    return counted.withColumn("allowed", F.col("before") < most)


def latency_alarms(events: DataFrame, limit: float = 30.0) -> DataFrame:
    return events.where(F.coalesce("elapsed", "duration", "span") > limit)


#: Services that a log may tell of: words of which one must be in the message, the word that names the service, and the type of its errors.
SERVICES = {"groq_api_failure": (("groq", "api"), "groq", "groq_api_error"), "supabase_failure": (("supabase", "rpc", "database"), "supabase", "supabase_error")}


def failure_alarms(logs: DataFrame, services: dict[str, tuple] = SERVICES) -> DataFrame:
    """Log rows (level, message, error_type) of errors with an alarm for each service that failed: alarm, severity, description.

    A service's words must be in the message, and its error's type on the row or its name in the message.
    """
    said = F.lower("message")
    found = []
    for alarm, (words, name, kind) in services.items():
        failed = said.rlike("|".join(words)) & (F.coalesce(F.col("error_type") == kind, F.lit(False)) | said.contains(name))
        found.append(F.when(failed, F.struct(F.lit(alarm).alias("alarm"), F.lit("critical").alias("severity"), F.concat(F.lit(f"Error en {name}: "), F.left("message", F.lit(200))).alias("description"))))
    return logs.where(F.col("level").isin("ERROR", "CRITICAL")).select(*logs.columns, F.inline(F.array_compact(F.array(*found))))


def health_alerts(jobs: DataFrame, active: DataFrame) -> DataFrame:
    """(job, severity) of jobs (job, health) that aren't healthy and have no active alert (job)."""
    return jobs.where("health <> 'healthy'").join(active.select("job"), "job", "left_anti").select("job", F.col("health").alias("severity"))


def channel_decisions(alerts: DataFrame, channels: DataFrame, bound: int = SMALL) -> DataFrame:
    """(id, channel, decision, template): alerts (id, ts, severity) at channels (channel, enabled, days, from_hour, to_hour, per_hour, and cooldown in minutes if there is one): sent, throttled or skipped.

    The hourly cap counts what would be sent. An alert within the cooldown after one that was sent is skipped. Weekdays are 1 (Monday) to 7.
    Every alert goes to each channel; up to `bound` channels are broadcast.
    """
    joined = alerts.crossJoin(F.broadcast(channels) if _small(channels, bound) else channels)
    hour, day = F.hour("ts"), F.weekday("ts") + 1
    open_ = F.col("enabled") & F.array_contains("days", day) & (hour >= F.col("from_hour")) & (hour < F.col("to_hour"))
    marked = joined.withColumn("_open", open_)
    template = F.when(F.col("severity") == "critical", "critical_template").otherwise("generic_template").alias("template")
    if "cooldown" in channels.columns:
        return _gated(marked.select("id", "channel", "_open", "per_hour", "cooldown", template, F.unix_micros(F.col("ts").cast("timestamp")).alias("_micros"), F.unix_micros(F.date_trunc("hour", F.col("ts")).cast("timestamp")).alias("_hour")))
    order = Window.partitionBy("channel", F.date_trunc("hour", "ts"), "_open").orderBy("ts", "id")
    ranked = marked.withColumn("_n", F.row_number().over(order))
    decision = F.when(~F.col("_open"), "skipped").when(F.col("_n") > F.col("per_hour"), "throttled").otherwise("sent")
    return ranked.select("id", "channel", decision.alias("decision"), template)


def alert_class(metric: Column, kind: Column) -> Column:
    """supabase by the metric's name, views_jobs by the alert's type, else system."""
    told = lambda c, *words: F.coalesce(c.rlike("|".join(words)), F.lit(False))
    return F.when(told(metric, "supabase"), "supabase").when(told(kind, "view", "job"), "views_jobs").otherwise("system")


def chosen_templates(alerts: DataFrame, channels: DataFrame, templates: DataFrame, bound: int = SMALL) -> DataFrame:
    """(id, channel, template): the template of each alert (id, metric, kind, severity) at each channel (channel, channel_type).

    templates: name, alert_type, severity, channel_type, created, active. The newest active one of the channel's type and the
    severity that is for the alert's class or for all (custom) is meant; without one the newest that is for all, of any severity;
    without that null, for the text by default. Only the newest of each kind count, so the table that meets the alerts has a row for
    each type of channel, severity and class; it is broadcast if it has `bound` rows at most, as the channels are.
    """
    live = templates.where("active").withColumn("_order", F.struct("created", "name"))
    exact = live.groupBy("channel_type", "severity", "alert_type").agg(F.max("_order").alias("_best"))
    spare = live.where("alert_type = 'custom'").groupBy("channel_type").agg(F.max("_order").alias("_spare"))
    small = lambda df: F.broadcast(df) if _small(df, bound) else df
    kinds = alerts.select("severity", alert_class(F.col("metric"), F.col("kind")).alias("_class")).distinct()
    for_class = kinds.join(small(exact), "severity").where(F.col("alert_type").isin("custom") | (F.col("alert_type") == F.col("_class")))
    for_class = for_class.groupBy("severity", "_class", "channel_type").agg(F.max("_best").alias("_best"))
    told = alerts.select("id", "severity", alert_class(F.col("metric"), F.col("kind")).alias("_class")).crossJoin(small(channels.select("channel", "channel_type")))  # every alert goes to each channel
    told = told.join(small(for_class), ["severity", "_class", "channel_type"], "left").join(small(spare), "channel_type", "left")
    return told.select("id", "channel", F.coalesce("_best.name", "_spare.name").alias("template"))


def _gated(rows: DataFrame) -> DataFrame:
    """Decisions in the order of time, per channel: what counts in an hour and when a cooldown starts depends on what was sent.

    Alerts that a channel isn't open for are skipped where they are. The others are decided run by run: after a gap longer than an
    hour and every cooldown nothing from before counts, so only a run without such a gap is one task's.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, hour, sent, last = None, None, 0, None
        for b in batches:
            decided = []
            for at, most, cooldown, ts, h in zip(zip(b["channel"], b["_run"], strict=True), b["per_hour"], b["cooldown"], b["_micros"], b["_hour"], strict=True):
                if at != current:
                    current, hour, sent, last = at, None, 0, None
                if h != hour:
                    hour, sent = h, 0
                if sent >= most:  # never where there is no cap
                    decided.append("throttled")
                elif last is not None and ts - last < cooldown * 60_000_000:
                    decided.append("skipped")
                else:
                    decided.append("sent")
                    sent, last = sent + 1, ts
            yield pd.DataFrame({"id": b["id"], "channel": b["channel"], "decision": decided, "template": b["template"]})

    kinds = dict(rows.dtypes)
    open_ = F.coalesce("_open", F.lit(False))
    closed = rows.where(~open_).select("id", "channel", F.lit("skipped").alias("decision"), "template")
    exact = rows.where(open_).withColumns({"per_hour": F.col("per_hour").cast("double"), "cooldown": F.col("cooldown").cast("double"), "seconds": F.col("_micros") / 1e6})
    wait = rows.agg(F.max(F.col("cooldown").cast("double"))).first()[0] or 0.0
    told = _runs(exact, "channel", max(3600.0, 60 * wait)).repartition("channel", "_run").sortWithinPartitions("channel", "_run", "_micros", "id")
    return told.mapInPandas(run, f"id {kinds['id']}, channel {kinds['channel']}, decision string, template string").unionByName(closed)


def flood_step(state: tuple | None, ts: float, most: int, period: float, escalate: int) -> tuple[tuple, bool, bool]:
    """State (attempts, start, escalated) after an alert at ts, whether it passes, and whether it escalates now."""
    attempts, start, escalated = state or (0, ts, False)
    if ts > start + period:
        attempts, start, escalated = 0, ts, False
    attempts += 1
    now = attempts >= escalate and not escalated
    return (attempts, start, escalated or now), attempts <= most, now


def _runs(rows: DataFrame, key: str, gap: float) -> DataFrame:
    """rows (key, seconds, ..) with _run: a key's rows between gaps longer than `gap` seconds, after which every state starts anew.

    Gaps lie between spans of that length, so a table of spans tells them: only a run without a gap is one task's.
    """
    spanned = rows.withColumn("_span", F.floor(F.col("seconds") / F.lit(float(gap))))
    spans = spanned.groupBy(F.col(key).alias("_k"), F.col("_span").alias("_s")).agg(F.min("seconds").alias("_first"), F.max("seconds").alias("_last"))
    order = Window.partitionBy("_k").orderBy("_s")  # a row a span
    fresh = F.coalesce(F.col("_first") - F.lag("_last").over(order) > gap, F.lit(True)).cast("int")
    numbered = spans.withColumn("_fresh", fresh).select("_k", "_s", F.sum("_fresh").over(order).alias("_run"))
    return spanned.join(numbered, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_span") == F.col("_s"))).select(*rows.columns, "_run")


def flood_control(alerts: DataFrame, key: str, most: int = 3, minutes: float = 60, escalate: int = 5) -> DataFrame:
    """(id, key, allowed, escalates) of alerts (id, ts, key) in the order of time, per key. A key's runs are read in batches, with only the state held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None  # rows come sorted by key, run and time; a run never spans two partitions
        for b in batches:
            passed, raised = [], []
            for k, ts in zip(zip(b[key], b["_run"], strict=True), b["seconds"], strict=True):
                if k != current:
                    current, state = k, None
                state, ok, now = flood_step(state, ts, most, minutes * 60, escalate)
                passed.append(ok)
                raised.append(now)
            yield pd.DataFrame({"id": b["id"], key: b[key], "allowed": passed, "escalates": raised})

    rows = alerts.select("id", key, (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"))
    kind = dict(alerts.dtypes)[key]
    return _runs(rows, key, minutes * 60).repartition(key, "_run").sortWithinPartitions(key, "_run", "seconds", "id").mapInPandas(run, f"id long, {key} {kind}, allowed boolean, escalates boolean")


def throttle(alerts: DataFrame, key: str, seconds: float = 60) -> DataFrame:
    """(id, key, allowed): at most one alert a key in the time after one that passed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, float("-inf")
        for b in batches:
            passed = []
            for k, ts in zip(zip(b[key], b["_run"], strict=True), b["seconds"], strict=True):
                if k != current:
                    current, last = k, float("-inf")
                passed.append(ts - last >= seconds)
                last = ts if passed[-1] else last
            yield pd.DataFrame({"id": b["id"], key: b[key], "allowed": passed})

    rows = alerts.select("id", key, (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"))
    kind = dict(alerts.dtypes)[key]
    return _runs(rows, key, seconds).repartition(key, "_run").sortWithinPartitions(key, "_run", "seconds", "id").mapInPandas(run, f"id long, {key} {kind}, allowed boolean")
