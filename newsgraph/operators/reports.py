"""Reports and dashboards over logs: executive and daily reports, resources, jobs, alerts, services, snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: From what use a resource warns and is critical; a share of hits is judged the other way round.
LIMITS = {"cpu": (75, 90), "memory": (80, 95), "connections": (80, 95)}
HITS = (90, 80)


def _seconds(a: Column, b: Column) -> Column:
    return F.unix_timestamp(b.cast("timestamp")) - F.unix_timestamp(a.cast("timestamp"))


def since(df: DataFrame, moment: str, now: DataFrame, hours: int) -> DataFrame:
    """df with now (one row), and only what is at most so many hours older."""
    return df.crossJoin(F.broadcast(now)).where(F.col(moment) > F.col("now") - F.make_dt_interval(F.lit(0), F.lit(hours)))


def executive(samples: DataFrame, alerts: DataFrame, now: DataFrame, hours: int, minutes: int = 5) -> DataFrame:
    """One row on the last hours: samples (ts, cpu, memory, connections, api, storage) and alerts (ts, severity, resolved_at).

    uptime is the share of expected samples (one in so many minutes); alerts that are open count up to now; advice is that of
    the first rule that holds, most urgent first.
    """
    used = since(samples, "ts", now, hours).agg(
        (F.count("*") * minutes * 100.0 / (hours * 60)).alias("uptime"), *[f(c).alias(f"{n}_{c}") for c in ("cpu", "memory", "connections") for n, f in (("mean", F.avg), ("peak", F.max))], F.max("api").alias("peak_api"), F.max("storage").alias("peak_storage")
    )
    severity, open_hours = F.col("severity"), _seconds(F.col("ts"), F.coalesce("resolved_at", "now")) / 3600.0
    told = since(alerts, "ts", now, hours).agg(F.count("*").alias("alerts"), F.count_if(severity == "critical").alias("critical"), F.count_if(severity == "warning").alias("warning"), F.count("resolved_at").alias("resolved"), F.avg(open_hours).alias("hours_open"))
    row = used.crossJoin(F.broadcast(told))  # one row each
    health = F.when(F.col("critical") > 0, "requires_attention").when(F.col("warning") > 0, "monitoring_recommended").otherwise("healthy")
    texts = lambda *names: F.array(*map(F.lit, names))
    advice = F.when((F.col("peak_cpu") > 90) | (F.col("peak_memory") > 95), texts("escalar_recursos", "revisar_consultas", "optimizar_rendimiento"))
    advice = advice.when((F.col("peak_api") > 85) | (F.col("peak_storage") > 85), texts("evaluar_plan", "reducir_llamadas", "revisar_almacenamiento"))
    advice = advice.when(F.col("alerts") > 0, texts("resolver_alertas", "ajustar_umbrales")).otherwise(texts("sistema_optimo", "seguir_monitoreo"))
    return row.withColumns({"health": health, "advice": advice})


def resource_days(samples: DataFrame, hits: str | None = None) -> DataFrame:
    """(day, resource, mean, peak, status) of samples (ts, and the resources of LIMITS); hits: a column with a share of cache hits."""
    each = [F.struct(F.lit(r).alias("resource"), F.col(r).cast("double").alias("value"), F.lit(w).alias("warn"), F.lit(c).alias("crit")) for r, (w, c) in LIMITS.items()]
    if hits:
        each.append(F.struct(F.lit("cache").alias("resource"), F.col(hits).cast("double").alias("value"), F.lit(HITS[0]).alias("warn"), F.lit(HITS[1]).alias("crit")))
    long = samples.select(F.to_date("ts").alias("day"), F.inline(F.array(*each)))
    summed = long.groupBy("day", "resource", "warn", "crit").agg(F.avg("value").alias("mean"), F.max("value").alias("peak"))
    used = F.when(F.col("peak") >= F.col("crit"), "critical").when(F.col("peak") >= F.col("warn"), "warning")
    hit = F.when(F.col("mean") < F.col("crit"), "critical").when(F.col("mean") < F.col("warn"), "warning")
    return summed.select("day", "resource", "mean", "peak", F.coalesce(F.when(F.col("resource") == "cache", hit).otherwise(used), F.lit("healthy")).alias("status"))


def job_day(jobs: DataFrame, runs: DataFrame, now: DataFrame, hours: int = 24) -> DataFrame:
    """(job, runs, failed, success_percent, health) of every job (job, active) over its last hours of runs (job, started, failed)."""
    recent = since(runs, "started", now, hours).groupBy("job").agg(F.count("*").alias("runs"), F.count_if("failed").alias("failed"))
    every = jobs.join(recent, "job", "left").na.fill(0, ["runs", "failed"])
    health = F.when(~F.col("active"), "disabled").when(F.col("failed") > 3, "critical").when((F.col("failed") > 0) | (F.col("runs") == 0), "warning").otherwise("healthy")
    return every.select("job", "runs", "failed", F.try_divide((F.col("runs") - F.col("failed")) * 100.0, F.col("runs")).alias("success_percent"), health.alias("health"))


def stored_sizes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, bytes, written) of tables in files, from their listing alone."""
    listed = [spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(p).agg(F.lit(name).alias("name"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.max("modificationTime").alias("written")) for name, p in paths.items()]
    return reduce(DataFrame.unionByName, listed)


def snapshot_status(snapshots: DataFrame, now: Column, most_bytes: int = 1 << 30) -> DataFrame:
    """snapshots (name, rows, bytes, refreshed) with status (no rows or over 1 GB: warning), age (1 and 24 hours) and freshness (2 and 6 hours)."""
    hours = _seconds(F.col("refreshed"), now) / 3600.0
    status = F.when((F.col("rows") == 0) | (F.col("bytes") > most_bytes), "warning").otherwise("healthy")
    age = F.when(hours.isNull(), "never").when(hours <= 1, "fresh").when(hours <= 24, "recent").otherwise("old")
    fresh = F.when(hours.isNull(), "never_refreshed").when(hours <= 2, "fresh").when(hours <= 6, "acceptable").otherwise("stale")
    return snapshots.withColumns({"status": status, "age": age, "freshness": fresh})


def snapshot_alerts(snapshots: DataFrame, active: DataFrame, now: DataFrame, stale_hours: int = 6, within_hours: int = 2) -> DataFrame:
    """(name, kind, severity): snapshots (name, status, refreshed) that are unhealthy or stale and have no active alert (name, kind, ts) of the last hours."""
    dated = snapshots.crossJoin(F.broadcast(now))
    hours = _seconds(F.col("refreshed"), F.col("now")) / 3600.0
    kinds = F.array_compact(F.array(
        F.when(F.col("status").isin("critical", "warning"), F.struct(F.lit("snapshot_health").alias("kind"), F.col("status").alias("severity"))),
        F.when(hours > stale_hours, F.struct(F.lit("snapshot_stale").alias("kind"), F.lit("warning").alias("severity"))),
    ))
    recent = since(active, "ts", now, within_hours).select("name", "kind").distinct()
    return dated.select("name", F.inline(kinds)).join(recent, ["name", "kind"], "left_anti")


def report_alerts(reports: DataFrame) -> DataFrame:
    """(day, kind, severity): an alert for each daily report (day, status, score) that is critical."""
    return reports.where("status = 'critical'").select("day", F.lit("daily_report_critical").alias("kind"), F.lit("critical").alias("severity"))


def status_ages(jobs: DataFrame, statuses: list[str], now: DataFrame) -> DataFrame:
    """(status, n, oldest, newest): every status, zeros kept, with ages in minutes, from jobs (status, ts)."""
    minutes = _seconds(F.col("ts"), F.col("now")) / 60.0
    found = jobs.crossJoin(F.broadcast(now)).groupBy("status").agg(F.count("*").alias("n"), F.max(minutes).alias("oldest"), F.min(minutes).alias("newest"))
    every = jobs.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return every.join(found, "status", "left").na.fill(0, ["n"])


def alert_listing(alerts: DataFrame) -> DataFrame:
    """(dimension, value, total, active, latest): alerts (id, ts, kind, severity, resolved_at) as a whole, by kind and by severity."""
    active = F.count_if(F.col("resolved_at").isNull()).alias("active")
    each = F.explode(F.array(F.struct(F.lit("all").alias("d"), F.lit("all").alias("v")), F.struct(F.lit("kind").alias("d"), F.col("kind").alias("v")), F.struct(F.lit("severity").alias("d"), F.col("severity").alias("v"))))
    long = alerts.withColumn("x", each)
    return long.groupBy(F.col("x.d").alias("dimension"), F.col("x.v").alias("value")).agg(F.count("*").alias("total"), active, F.max_by("id", F.struct("ts", "id")).alias("latest"))


def errors_by_type(rows: DataFrame, errors: str = "errors") -> DataFrame:
    """(error, n): how often each name of an array column of errors occurs."""
    return rows.select(F.explode(errors).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


def data_freshness(events: DataFrame, key: str, moment: str, now: DataFrame) -> DataFrame:
    """(key, minutes, freshness, status): how old each source's latest row is: fresh to 10 minutes, stale to 30, then outdated."""
    latest = events.groupBy(key).agg(F.max(moment).alias("_latest")).crossJoin(F.broadcast(now))
    minutes = _seconds(F.col("_latest"), F.col("now")) / 60.0
    fresh = F.when(minutes <= 10, "fresh").when(minutes <= 30, "stale").otherwise("outdated")
    status = F.when(minutes <= 10, "healthy").when(minutes <= 30, "warning").otherwise("critical")
    return latest.select(key, minutes.alias("minutes"), fresh.alias("freshness"), status.alias("status"))


def rated(df: DataFrame, value: str) -> DataFrame:
    """df with rating: very_poor, poor, fair, good or excellent by 5000, 1000, 500 and 100."""
    v = F.col(value)
    return df.withColumn("rating", F.when(v > 5000, "very_poor").when(v > 1000, "poor").when(v > 500, "fair").when(v > 100, "good").otherwise("excellent"))


def failing_hosts(fetches: DataFrame, key: str, ok: str, most: int = 5) -> DataFrame:
    """(key, failures) of sources with more failures than that."""
    return fetches.groupBy(key).agg(F.count_if(~F.col(ok)).alias("failures")).where(F.col("failures") > most)


def latest(df: DataFrame, *order: str) -> DataFrame:
    """The latest row alone, from one pass."""
    return df.agg(F.max_by(F.struct("*"), F.struct(*order)).alias("_r")).select("_r.*")


def dashboard(samples: DataFrame, alerts: DataFrame, jobs: DataFrame, now: DataFrame, hours: int = 24, top: int = 5) -> DataFrame:
    """One row: the latest sample (ts, cpu, memory, connections), counts of jobs (health) and open alerts, counts by category, the `top` most urgent
    open alerts (id, ts, severity, category, resolved_at), and alerts an hour of the last hours as two arrays in order."""
    system = latest(samples, "ts").select(F.struct("cpu", "memory", "connections").alias("system"))
    counted = jobs.agg(F.struct(F.count("*").alias("total"), F.count_if(F.col("health") == "critical").alias("critical"), F.count_if(F.col("health") == "warning").alias("warning")).alias("jobs"))
    open_ = alerts.where("resolved_at is null")
    by = open_.groupBy("category").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("categories"))
    rank = F.when(F.col("severity") == "critical", 1).when(F.col("severity") == "warning", 2).otherwise(3)
    first = open_.select(rank.alias("rank"), (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("age"), "id").orderBy("rank", "age", "id").limit(top)
    urgent = first.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "age", "id"))), lambda x: x["id"]).alias("urgent"))
    trend = since(alerts, "ts", now, hours).groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("hour")).agg(F.count("*").alias("n"))
    points = trend.agg(F.sort_array(F.collect_list(F.struct("hour", "n"))).alias("p")).select(F.col("p.hour").alias("hours"), F.col("p.n").alias("counts"))
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [system, counted, by, urgent, points])  # one row each


def service_dashboard(events: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """One row over (ts, kind, value, ok): articles and fragments an hour of uptime (at least a hundredth), latency percentiles, success of each phase.

    Percentiles are approximate with a bounded summary: ranks are off by n / accuracy at most.
    """
    hours = F.greatest(_seconds(F.min("ts"), F.max("ts")) / 3600.0, F.lit(0.01))
    p = F.percentile_approx("value", [0.95, 0.99], accuracy)
    row = events.agg(hours.alias("hours"), (F.count_if((F.col("kind") == "article") & F.col("ok")) / hours).alias("articles_hour"), (F.count_if((F.col("kind") == "fragment") & F.col("ok")) / hours).alias("fragments_hour"), p[0].alias("p95"), p[1].alias("p99"))
    phases = events.groupBy("kind").agg((F.count_if("ok") * 100.0 / F.count("*")).alias("s")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "s")))).alias("success"))
    return row.crossJoin(F.broadcast(phases))  # one row each


def report_rows(reports: DataFrame) -> DataFrame:
    """Stored reports as JSON columns (alerts, metrics) and a list of advice: day, status, score, alerts, metrics, advice."""
    return reports.select(
        "day", "status", "score", F.to_json(F.struct(F.col("total").alias("total"), F.struct(F.col("errors").alias("critical")).alias("by_severity"))).alias("alerts"),
        F.to_json(F.struct(F.struct(F.col("peak").alias("maximum"), F.col("mean").alias("average")).alias("value"))).alias("metrics"), F.filter(F.split("advice", ","), lambda x: x != "").alias("advice"),
    )


def report_list(stored: DataFrame) -> DataFrame:
    """(day, status, score, total, critical, maximum, recommendations), newest first, by paths into the JSON."""
    path = lambda c, p, kind: F.get_json_object(c, p).cast(kind)
    return stored.select(
        "day", "status", "score", path("alerts", "$.total", "long").alias("total"), path("alerts", "$.by_severity.critical", "long").alias("critical"), path("metrics", "$.value.maximum", "double").alias("maximum"), F.size("advice").alias("recommendations"),
    ).orderBy(F.desc("day"))
