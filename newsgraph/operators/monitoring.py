"""Metric, alert and job logs: roll-ups, reports, statistics, status and series for dashboards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITY = {"info": 0, "warning": 1, "critical": 2}


def rollup(df: DataFrame, moment: str, unit: str, value: str, *by: str, every_minutes: int = 5) -> DataFrame:
    """(by.., bucket, n, mean, least, most, total, uptime): per hour or day; uptime as the share of expected samples."""
    expected = {"hour": 60, "day": 24 * 60}[unit] / every_minutes
    grouped = df.groupBy(*by, F.date_trunc(unit, moment).alias("bucket"))
    return grouped.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.sum(value).alias("total"), F.least(F.lit(100.0), F.count("*") * 100 / F.lit(expected)).alias("uptime"))


def numbered(df: DataFrame, by: str, *order: str, seconds: float = 86_400) -> DataFrame:
    """df with _n: the place of a row among those of its source in the order of a moment and what breaks ties.

    Places are counted within spans of time and added up over a table of spans, so a source isn't one task's.
    """
    spanned = df.withColumn("_span", F.floor(F.unix_micros(F.col(order[0]).cast("timestamp")) / F.lit(int(seconds * 1e6))))
    spans = spanned.groupBy(F.col(by).alias("_k"), F.col("_span").alias("_s")).agg(F.count("*").alias("_c"))
    before = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # a row a span
    offsets = spans.select("_k", "_s", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    joined = spanned.join(offsets, F.col(by).eqNullSafe(F.col("_k")) & F.col("_span").eqNullSafe(F.col("_s")))
    place = F.row_number().over(Window.partitionBy(by, "_span").orderBy(*order)) + F.col("_before")
    return joined.withColumn("_n", place).select(*df.columns, "_n")


def changes(df: DataFrame, by: str, moment: str, value: str, back: int = 1, tie: str | None = None) -> DataFrame:
    """df with before, delta and percent against the sample `back` rows earlier of the same source, joined by its place."""
    placed = numbered(df, by, *[c for c in (moment, tie) if c])
    earlier = placed.select(F.col(by).alias("_by"), (F.col("_n") + back).alias("_at"), F.col(value).alias("before"))
    out = placed.join(earlier, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_n") == F.col("_at")), "left").select(*df.columns, "before")
    return out.withColumn("delta", F.col(value) - F.col("before")).withColumn("percent", F.try_divide(F.col("delta") * 100.0, F.col("before")))


def growth(df: DataFrame, by: str, moment: str, value: str, samples: int = 288, tie: str | None = None) -> DataFrame:
    """Growth against a day's samples earlier."""
    return changes(df, by, moment, value, samples, tie)


def bottleneck(df: DataFrame, resources: list[str]) -> DataFrame:
    """df with load (mean of the resources), bottleneck (the first that is largest) and its health class."""
    most = F.greatest(*resources)
    name = reduce(lambda c, r: c.when(F.col(r) == most, r), resources[1:], F.when(F.col(resources[0]) == most, resources[0]))
    health = F.when(most >= 95, "critical").when(most >= 85, "warning").when(most >= 70, "attention").otherwise("healthy")
    return df.withColumns({"load": sum((F.col(r) for r in resources), F.lit(0.0)) / len(resources), "bottleneck": name, "health": health})


def alert_history(alerts: DataFrame, k: int = 3) -> DataFrame:
    """(day, total, critical, warning, resolved, hours, top): alerts (ts, severity, metric, resolved_at) per day; hours is the mean time to resolve, top the k commonest metrics."""
    dated = alerts.withColumn("day", F.to_date("ts"))
    hours = (F.unix_timestamp(F.col("resolved_at").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 3600.0
    summed = dated.groupBy("day").agg(F.count("*").alias("total"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warning").alias("warning"), F.count("resolved_at").alias("resolved"), F.avg(hours).alias("hours"))
    return summed.join(top_per(dated, "day", "metric", k), "day", "left")


def top_per(df: DataFrame, by: str, what: str, k: int) -> DataFrame:
    """(by, top): the k commonest values with their counts, as text; ties by value."""
    counted = df.groupBy(by, what).agg(F.count("*").alias("n"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), what))).where(F.col("r") <= k)
    listed = F.array_sort(F.collect_list(F.struct("r", F.concat_ws(":", what, F.col("n").cast("string")).alias("t"))))
    return ranked.groupBy(by).agg(F.array_join(F.transform(listed, lambda x: x["t"]), ",").alias("top"))


def daily_report(events: DataFrame, high_mean: float = 51, mean: float = 49, peak: float = 300) -> DataFrame:
    """(day, total, errors, error_percent, mean, peak, score, status, advice) from (ts, kind, value): 10 less penalties, for all days at once."""
    e = F.count_if(F.col("kind") == "error")
    summed = events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("total"), e.alias("errors"), F.avg("value").alias("mean"), F.max("value").alias("peak"))
    rate = F.col("errors") * 100.0 / F.col("total")
    penalty = F.when(rate > 25, 3).when(rate > 20, 2).when(rate > 15, 1).otherwise(0) + F.when(F.col("mean") > high_mean, 2).when(F.col("mean") > mean, 1).otherwise(0) + F.when(F.col("peak") > peak, 1).otherwise(0)
    score = F.least(F.lit(10), F.greatest(F.lit(0), 10 - penalty))
    advice = F.array_join(F.array_compact(F.array(F.when(rate > 20, "revisar_errores"), F.when(F.col("mean") > high_mean, "optimizar_consultas"), F.when(F.col("peak") > peak, "revisar_picos"))), ",")
    scored = summed.withColumns({"error_percent": rate, "score": score, "advice": advice})
    return scored.withColumn("status", F.when(F.col("score") >= 8, "healthy").when(F.col("score") >= 6, "warning").otherwise("critical"))


def job_stats(runs: DataFrame) -> DataFrame:
    """(job, runs, failed, success_percent, mean, most, least, last, health) from runs (job, started, seconds, failed)."""
    failed = F.count_if("failed")
    summed = runs.groupBy("job").agg(F.count("*").alias("runs"), failed.alias("failed"), F.avg("seconds").alias("mean"), F.max("seconds").alias("most"), F.min("seconds").alias("least"), F.max("started").alias("last"))
    health = F.when(F.col("failed") > 3, "critical").when(F.col("failed") > 0, "warning").otherwise("healthy")
    return summed.withColumns({"success_percent": (F.col("runs") - F.col("failed")) * 100.0 / F.col("runs"), "health": health})


def snapshot_health(tables: dict[str, DataFrame], moment: dict[str, str], now: Column) -> DataFrame:
    """(name, rows, updated, age, status): rows and latest moment of each snapshot; empty or stale ones warn."""
    each = [df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.max(moment[name]).cast("timestamp").alias("updated")) for name, df in tables.items()]
    hours = (F.unix_timestamp(now) - F.unix_timestamp("updated")) / 3600.0
    age = F.when(hours <= 1, "fresh").when(hours <= 24, "recent").when(hours.isNotNull(), "stale").otherwise("never")
    found = reduce(DataFrame.unionByName, each)
    return found.withColumn("age", age).withColumn("status", F.when(F.col("rows") == 0, "warning").when(F.col("age").isin("stale", "never"), "warning").otherwise("healthy"))


def by_category(alerts: DataFrame) -> DataFrame:
    """(category, counts): active alerts by category, a map from severity to count."""
    counted = alerts.groupBy("category", "severity").agg(F.count("*").alias("n"))
    return counted.groupBy("category").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "n")))).alias("counts"))


def run_history(runs: DataFrame) -> DataFrame:
    """(category, total, passed, success_percent, last_passed) from (category, name, passed, ts)."""
    grouped = runs.groupBy("category").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.max_by(F.when(F.col("passed"), F.col("name")), F.when(F.col("passed"), F.struct("ts", "name"))).alias("last_passed"))
    return grouped.withColumn("success_percent", F.col("passed") * 100.0 / F.col("total"))


def percentiles(df: DataFrame, by: str, value: str, shares: dict[str, float], band: float = 0.001, accuracy: int = 10_000) -> DataFrame:
    """(by, and a column for each share): exact percentiles, between neighbours by their distance, nulls aside.

    An approximate summary, bounded whatever the group's size, gives a band around each share; only what lies in it is
    sorted, by value and how often it occurs, so no task holds a group's values.
    """
    rows = df.select(F.col(by).alias("_k"), F.col(value).cast("double").alias("_x")).where("_x is not null")
    around = [x for p in shares.values() for x in (max(0.0, p - band), min(1.0, p + band))]
    known = rows.groupBy("_k").agg(F.count("*").alias("_n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"), F.percentile_approx("_x", around, accuracy).alias("_q"))
    if accuracy * band < 2:
        raise ValueError("the summary's own error has to lie within the band")
    few = F.col("_n") * band < 5  # neighbours may lie outside the band: the whole group, 5 / band values at most, is in it
    edge = lambda i, far: F.when(few | F.lit(around[i] in (0.0, 1.0)), F.col(far)).otherwise(F.col("_q")[i])
    bands = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("_n") - 1)).alias("place"), edge(2 * i, "_min").alias("low"), edge(2 * i + 1, "_max").alias("high")) for i, (name, p) in enumerate(shares.items())])
    asked = rows.join(known.select(F.col("_k").alias("_g"), bands.alias("_b")), F.col("_k").eqNullSafe(F.col("_g"))).select("_k", "_x", F.inline("_b"))
    below = asked.groupBy("_k", "name").agg(F.count_if(F.col("_x") < F.col("low")).alias("below"))
    counted = asked.where(F.col("_x").between(F.col("low"), F.col("high"))).groupBy("_k", "name", "place", "_x").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("_k", "name").orderBy("_x"))
    placed = counted.withColumn("upto", upto).join(below.select(F.col("_k").alias("_g"), F.col("name").alias("_name"), "below"), F.col("_k").eqNullSafe(F.col("_g")) & (F.col("name") == F.col("_name")))
    at = lambda place: F.min(F.when(F.col("below") + F.col("upto") > place, F.col("_x")))
    found = placed.groupBy("_k", "name", "place").agg(at(F.floor("place")).alias("lower"), at(F.ceil("place")).alias("upper"))
    exact = F.col("lower") + (F.col("upper") - F.col("lower")) * (F.col("place") - F.floor("place"))
    return found.groupBy(F.col("_k").alias(by)).agg(*[F.max(F.when(F.col("name") == name, exact)).alias(name) for name in shares])


def load_report(results: DataFrame, pass_mark: float = 95.0) -> DataFrame:
    """(suite, tests, passed_percent, mean_ms, p95, p99, peak) from (suite, success_rate, response_ms, throughput); exact percentiles."""
    summed = results.groupBy("suite").agg(F.count("*").alias("tests"), (F.count_if(F.col("success_rate") >= pass_mark) * 100.0 / F.count("*")).alias("passed_percent"), F.avg("response_ms").alias("mean_ms"), F.max("throughput").alias("peak"))
    exact = percentiles(results, "suite", "response_ms", {"p95": 0.95, "p99": 0.99})
    return summed.join(exact, "suite", "left").select("suite", "tests", "passed_percent", "mean_ms", "p95", "p99", "peak")


def channel_stats(sent: DataFrame) -> DataFrame:
    """(channel, total, sent, failed, success_percent, mean_ms) of notifications (channel, ok, ms)."""
    return sent.groupBy("channel").agg(F.count("*").alias("total"), F.count_if("ok").alias("sent"), F.count_if(~F.col("ok")).alias("failed"), (F.count_if("ok") * 100.0 / F.count("*")).alias("success_percent"), F.avg(F.when(F.col("ok"), F.col("ms"))).alias("mean_ms"))


def service_metrics(events: DataFrame) -> DataFrame:
    """One row over (ts, kind, value, ok): requests a minute, mean latency, error percentage, throughput an hour."""
    minutes = F.greatest(F.lit(1.0), (F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))) / 60.0)
    return events.agg((F.count("*") / minutes).alias("per_minute"), F.avg("value").alias("latency"), F.try_divide(F.count_if(~F.col("ok")) * 100.0, F.count("*")).alias("error_percent"), (F.count_if("ok") / F.greatest(F.lit(0.01), minutes / 60)).alias("per_hour"))


def phase_stats(events: DataFrame) -> DataFrame:
    """(kind, n, success_percent, mean, p95, p99): real percentiles of each phase."""
    summed = events.groupBy("kind").agg(F.count("*").alias("n"), (F.count_if("ok") * 100.0 / F.count("*")).alias("success_percent"), F.avg("value").alias("mean"))
    return summed.join(percentiles(events, "kind", "value", {"p95": 0.95, "p99": 0.99}), "kind", "left")


def totals(events: DataFrame) -> DataFrame:
    """One row: n, seconds per item, errors per item; nothing divides by zero."""
    return events.agg(F.count("*").alias("n"), F.try_divide(F.sum("value"), F.count("*")).alias("mean_seconds"), (F.count_if(~F.col("ok")) / F.greatest(F.lit(1), F.count("*"))).alias("error_rate"))


def status_counts(jobs: DataFrame, statuses: list[str]) -> DataFrame:
    """(status, n): every status, zeros kept, from jobs (status)."""
    one = jobs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses])
    each = ", ".join(f"'{s}', `{s}`" for s in statuses)
    return one.select(F.expr(f"stack({len(statuses)}, {each}) as (status, n)"))


def alert_summary(alerts: DataFrame) -> DataFrame:
    """One row over (id, ts, severity, resolved_at): total, active, resolved, critical, latest id."""
    return alerts.agg(F.count("*").alias("total"), F.count_if(F.col("resolved_at").isNull()).alias("active"), F.count("resolved_at").alias("resolved"), F.count_if(F.col("severity") == "critical").alias("critical"), F.max_by("id", F.struct("ts", "id")).alias("latest"))


def status_rollup(components: DataFrame) -> DataFrame:
    """(group, components, worst): components (group, status) to the worst of each group."""
    rank = F.when(F.col("status") == "critical", 2).when(F.col("status") == "warning", 1).otherwise(0)
    worst = F.element_at(F.array(F.lit("healthy"), F.lit("warning"), F.lit("critical")), F.max(rank) + 1)
    return components.groupBy("group").agg(F.count("*").alias("components"), worst.alias("worst"))


def freshness(minutes: Column) -> Column:
    return F.when(minutes <= 10, "fresh").when(minutes <= 30, "stale").otherwise("outdated")


def chart(df: DataFrame, series: str, x: str, y: str) -> DataFrame:
    """(series, labels, data): ordered arrays for charts, from already grouped rows."""
    points = F.sort_array(F.collect_list(F.struct(F.col(x).cast("string").alias("x"), F.col(y).alias("y"))))
    return df.groupBy(F.col(series).alias("series")).agg(points["x"].alias("labels"), points["y"].alias("data"))


def unified(system: DataFrame, platform: DataFrame) -> DataFrame:
    """Rows of both kinds in one schema, with nulls for what a kind lacks."""
    return system.withColumn("component", F.lit("system")).unionByName(platform.withColumn("component", F.lit("platform")), allowMissingColumns=True)


def latest_per(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(o) for o in order]))
    return df.withColumn("_n", rank).where("_n = 1").drop("_n")


def prioritised(alerts: DataFrame) -> DataFrame:
    """Alerts with a priority of 1 to 6 by severity and category, most urgent and then newest first."""
    critical, own = F.col("severity") == "critical", F.col("category")
    priority = F.when(critical & (own == "system"), 1).when(critical & (own == "data"), 2).when(critical, 3).when(F.col("severity").isin("warning") & (own == "system"), 4).when(F.col("severity") == "warning", 5).otherwise(6)
    return alerts.withColumn("priority", priority).orderBy("priority", F.desc("ts"), "id")


def category(kind: Column) -> Column:
    return F.when(kind.isin("error", "signup"), "system").when(kind.like("p%"), "data").otherwise("service")


def alert_category(metric: Column, kind: Column | None = None) -> Column:
    """The category of an alert's metric; with its kind, alerts on views and on jobs are told apart first."""
    limits = metric.isin("api_requests_limit", "storage_limit", "bandwidth_limit")
    out = F.when(limits, "supabase_limit").when(metric.contains("edge_function"), "supabase_edge").when(metric.contains("api_"), "supabase_api")
    out = out.when(metric.isin("cpu_usage_percent", "memory_usage_percent"), "system_resource").when(metric.isin("connection_usage_percent", "cache_hit_ratio"), "database_performance").otherwise("other")
    return out if kind is None else F.when(kind.contains("materialized_view") | kind.contains("pg_cron"), "views_jobs").otherwise(out)


def component(kind: Column) -> Column:
    return F.when(kind.contains("materialized_view"), "materialized_view").when(kind.contains("pg_cron"), "pg_cron_job").otherwise("other")


def job_class(name: Column) -> Column:
    has = lambda *words: name.rlike("|".join(words))
    return F.when(has("monitoring", "collect"), "monitoring").when(has("cleanup", "maintenance"), "maintenance").when(has("backup", "critical"), "critical").otherwise("regular")


def recorded(requests: DataFrame, pipelines: DataFrame, phases: DataFrame) -> DataFrame:
    """One append-only table of metric events (ts, kind, name, value, ok) of three kinds: request (path), pipeline (job) and phase (phase)."""
    kinds = (("request", requests, "path"), ("pipeline", pipelines, "job"), ("phase", phases, "phase"))
    return reduce(DataFrame.unionByName, [df.select("ts", F.lit(k).alias("kind"), F.col(name).cast("string").alias("name"), "value", "ok") for k, df, name in kinds])


def window_metrics(events: DataFrame, now: DataFrame, hours: int = 24) -> DataFrame:
    """(kind, n, mean, error_percent) over the last hours of recorded events; now: one row."""
    recent = events.crossJoin(F.broadcast(now)).where(F.col("ts") > F.col("now") - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return recent.groupBy("kind").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), (F.count_if(~F.col("ok")) * 100.0 / F.count("*")).alias("error_percent"))


def slow(df: DataFrame, name: str, value: str, least: float, n: int) -> DataFrame:
    """The n slowest of those that take `least` on average: calls, mean, most, deviation."""
    grouped = df.groupBy(name).agg(F.count("*").alias("calls"), F.avg(value).alias("mean"), F.max(value).alias("most"), F.stddev_samp(value).alias("deviation"))
    return grouped.where(F.col("mean") >= least).orderBy(F.desc("mean"), name).limit(n)


def arrivals(fetches: DataFrame, key: str, moment: str, delay: float, slow_value: float, tie: str) -> DataFrame:
    """(key, fetches, too_soon, slow): fetches that came sooner after their predecessor than 0.9 of the delay, and slow ones."""
    gap = F.unix_micros(F.col(moment).cast("timestamp")) - F.unix_micros(F.lag(F.col(moment).cast("timestamp")).over(Window.partitionBy(key).orderBy(moment, tie)))
    marked = fetches.withColumn("_gap", gap / 1e6)
    return marked.groupBy(key).agg(F.count("*").alias("fetches"), F.count_if(F.col("_gap") < delay * 0.9).alias("too_soon"), F.count_if(F.col("value") > slow_value).alias("slow"))


def period_report(events: DataFrame, alerts: DataFrame, hours: int) -> DataFrame:
    """One row on the last hours before the latest event: samples, errors, peak and mean, alerts by severity, resolution, status, advice.

    events (ts, kind, value, ok) and alerts (ts, severity, resolved_at) are each read once; both sums are one row.
    """
    now = F.broadcast(events.agg(F.max("ts").alias("now")))
    recent = lambda df: df.crossJoin(now).where(F.col("ts") > F.col("now") - F.make_dt_interval(F.lit(0), F.lit(hours)))
    used = recent(events).agg(F.count("*").alias("samples"), F.count_if(~F.col("ok")).alias("errors"), F.max("value").alias("peak"), F.avg("value").alias("mean"))
    open_for = (F.unix_timestamp(F.col("resolved_at").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 60.0
    told = recent(alerts).agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warning").alias("warning"), F.count_if(F.col("resolved_at").isNull()).alias("open"), F.avg(open_for).alias("minutes_to_resolve"))
    row = used.crossJoin(F.broadcast(told))  # one row each
    status = F.when((F.col("critical") > 0) & (F.col("open") > 0), "critical").when(F.col("warning") > 0, "warning").otherwise("healthy")
    rules = F.array_compact(F.array(F.when(F.col("open") > 0, "atender_alertas"), F.when(F.try_divide(F.col("errors") * 1.0, F.col("samples")) > 0.15, "revisar_errores"), F.when(F.col("minutes_to_resolve") > 30, "reducir_tiempos")))
    return row.withColumns({"status": status, "advice": F.array_join(rules, ",")})
