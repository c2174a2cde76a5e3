"""Registered queries over logs: the events table stands for metric samples, alerts, jobs and notifications."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from newsgraph.operators import monitoring as op
from newsgraph.plans import model
from newsgraph.registry import query


def _events(spark, sf_dir):
    return model.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("kind"), "value", (F.col("event_type") != "error").alias("ok"))


def _alerts(spark, sf_dir):
    """Errors and signups are alerts; the value tells severity, and how long they stay open."""
    v = F.col("value")
    resolved = F.when(v < 150, F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.floor(v).cast("int")))
    rows = _events(spark, sf_dir).where("kind in ('error', 'signup')")
    return rows.select(F.col("event_id").alias("id"), "ts", F.when(v >= 120, "critical").when(v >= 60, "warning").otherwise("info").alias("severity"), F.concat(F.lit("m"), F.pmod("user_id", F.lit(7))).alias("metric"), resolved.alias("resolved_at"), op.category(F.col("kind")).alias("category"), "value")


_ALERTS = """a AS (SELECT event_id AS id, ts, CASE WHEN value >= 120 THEN 'critical' WHEN value >= 60 THEN 'warning' ELSE 'info' END AS severity, 'm' || (user_id % 7) AS metric,
  CASE WHEN value < 150 THEN ts + to_minutes(floor(value)::INTEGER) END AS resolved_at, CASE WHEN event_type IN ('error', 'signup') THEN 'system' WHEN event_type LIKE 'p%' THEN 'data' ELSE 'service' END AS category, value
  FROM events WHERE event_type IN ('error', 'signup'))"""


def _round(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("""SELECT event_type AS kind, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS bucket, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(sum(value), 4) AS total, round(least(100.0, count(*) * 100 / 12.0), 6) AS uptime FROM events GROUP BY 1, 2""")
def hourly_rollup(spark, sf_dir):
    df = op.rollup(_events(spark, sf_dir), "ts", "hour", "value", "kind")
    return _round(_round(df, "mean", "uptime"), "total", digits=4).withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH"))


@query("""SELECT event_type AS kind, ts::DATE AS bucket, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(sum(value), 4) AS total, round(least(100.0, count(*) * 100 / 288.0), 6) AS uptime FROM events GROUP BY 1, 2""")
def daily_rollup(spark, sf_dir):
    df = op.rollup(_events(spark, sf_dir), "ts", "day", "value", "kind")
    return _round(_round(df, "mean", "uptime"), "total", digits=4).withColumn("bucket", F.to_date("bucket"))


@query("""SELECT event_id, round(value - b, 6) AS delta, round((value - b) * 100.0 / nullif(b, 0), 6) AS percent FROM (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS b FROM events)""")
def sample_changes(spark, sf_dir):
    return _round(op.changes(_events(spark, sf_dir), "kind", "ts", "value", tie="event_id").select("event_id", "delta", "percent"), "delta", "percent")


@query("""SELECT event_id, round(value - lag(value, 288) OVER (PARTITION BY event_type ORDER BY ts, event_id), 6) AS delta FROM events""")
def growth_lag(spark, sf_dir):
    return _round(op.growth(_events(spark, sf_dir), "kind", "ts", "value", tie="event_id").select("event_id", "delta"), "delta")


_WIDE = """w AS (SELECT date_trunc('hour', ts) AS hour, coalesce(avg(value) FILTER (event_type = 'click'), 0) / 5 AS cpu, coalesce(avg(value) FILTER (event_type = 'view'), 0) / 5 AS memory,
  coalesce(avg(value) FILTER (event_type = 'purchase'), 0) / 5 AS storage, coalesce(avg(value) FILTER (event_type = 'error'), 0) / 5 AS connections FROM events GROUP BY 1)"""


def _wide(spark, sf_dir):
    own = lambda kind: (F.coalesce(F.avg(F.when(F.col("kind") == kind, F.col("value"))), F.lit(0.0)) / 5)
    return _events(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(own("click").alias("cpu"), own("view").alias("memory"), own("purchase").alias("storage"), own("error").alias("connections"))


@query(f"""WITH {_WIDE}, g AS (SELECT *, greatest(cpu, memory, storage, connections) AS most FROM w)
SELECT strftime(hour, '%Y-%m-%d %H') AS hour, round((cpu + memory + storage + connections) / 4, 6) AS load, CASE most WHEN cpu THEN 'cpu' WHEN memory THEN 'memory' WHEN storage THEN 'storage' ELSE 'connections' END AS bottleneck,
  CASE WHEN most >= 95 THEN 'critical' WHEN most >= 85 THEN 'warning' WHEN most >= 70 THEN 'attention' ELSE 'healthy' END AS health FROM g""")
def resource_bottleneck(spark, sf_dir):
    df = op.bottleneck(_wide(spark, sf_dir), ["cpu", "memory", "storage", "connections"])
    return df.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), F.round("load", 6).alias("load"), "bottleneck", "health")


@query(f"""WITH {_ALERTS}, s AS (SELECT ts::DATE AS day, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(resolved_at) AS resolved, round(avg(epoch(date_trunc('second', resolved_at)) - epoch(date_trunc('second', ts))) / 3600.0, 5) AS hours FROM a GROUP BY 1),
c AS (SELECT ts::DATE AS day, metric, count(*) AS n FROM a GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, metric) AS r FROM c)
SELECT s.*, (SELECT string_agg(metric || ':' || n, ',' ORDER BY r) FROM r WHERE r.day = s.day AND r <= 3) AS top FROM s""")
def alert_history(spark, sf_dir):
    return _round(op.alert_history(_alerts(spark, sf_dir)), "hours", digits=5)


@query("""WITH s AS (SELECT ts::DATE AS day, count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, avg(value) AS mean, max(value) AS peak FROM events GROUP BY 1), r AS (SELECT *, errors * 100.0::DOUBLE / total AS rate FROM s),
p AS (SELECT *, least(10, greatest(0, 10 - (CASE WHEN rate > 25 THEN 3 WHEN rate > 20 THEN 2 WHEN rate > 15 THEN 1 ELSE 0 END) - (CASE WHEN mean > 51 THEN 2 WHEN mean > 49 THEN 1 ELSE 0 END) - (CASE WHEN peak > 300 THEN 1 ELSE 0 END)))::INTEGER AS score FROM r)
SELECT day, total, errors, round(rate, 6) AS error_percent, round(mean, 6) AS mean, peak, score, concat_ws(',', CASE WHEN rate > 20 THEN 'revisar_errores' END, CASE WHEN mean > 51 THEN 'optimizar_consultas' END, CASE WHEN peak > 300 THEN 'revisar_picos' END) AS advice,
  CASE WHEN score >= 8 THEN 'healthy' WHEN score >= 6 THEN 'warning' ELSE 'critical' END AS status FROM p""")
def daily_report(spark, sf_dir):
    return _round(op.daily_report(_events(spark, sf_dir)), "error_percent", "mean")


@query("""WITH s AS (SELECT user_id AS job, count(*) AS runs, count(*) FILTER (event_type = 'error') AS failed, round(avg(value), 6) AS mean, max(value) AS most, min(value) AS least, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY 1)
SELECT *, round((runs - failed) * 100.0::DOUBLE / runs, 6) AS success_percent, CASE WHEN failed > 3 THEN 'critical' WHEN failed > 0 THEN 'warning' ELSE 'healthy' END AS health FROM s""")
def job_stats(spark, sf_dir):
    runs = _events(spark, sf_dir).select(F.col("user_id").alias("job"), F.col("ts").alias("started"), F.col("value").alias("seconds"), (~F.col("ok")).alias("failed"))
    return _round(op.job_stats(runs), "mean", "success_percent").withColumn("last", F.date_format("last", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH n AS (SELECT max(ts) + INTERVAL 30 MINUTE AS now FROM events), t AS (SELECT 'orders' AS name, count(*) AS rows, max(o_orderdate)::TIMESTAMP AS d FROM orders UNION ALL SELECT 'events', count(*), max(ts) FROM events UNION ALL SELECT 'large', count(*), max(ts) FROM events WHERE value > 250
UNION ALL SELECT 'none', 0, NULL::TIMESTAMP), h AS (SELECT *, (epoch(date_trunc('second', now)) - epoch(date_trunc('second', d))) / 3600.0 AS hours FROM t, n)
SELECT name, rows, CASE WHEN hours IS NULL THEN 'never' WHEN hours <= 1 THEN 'fresh' WHEN hours <= 24 THEN 'recent' ELSE 'stale' END AS age, CASE WHEN rows = 0 OR hours IS NULL OR hours > 24 THEN 'warning' ELSE 'healthy' END AS status FROM h""")
def snapshot_health(spark, sf_dir):
    """Tables half an hour after the latest event: one just written, one older, some rare rows of it, and an empty one."""
    events = model.table(spark, sf_dir, "events")
    t = {"orders": model.table(spark, sf_dir, "orders"), "events": events, "large": events.where("value > 250"), "none": events.where("false")}
    now = (events.agg(F.max("ts").alias("now")).first().now + timedelta(minutes=30)).isoformat(sep=" ")  # one row
    return op.snapshot_health(t, {"orders": "o_orderdate", "events": "ts", "large": "ts", "none": "ts"}, F.lit(now).cast("timestamp")).drop("updated")


@query(f"WITH {_ALERTS} SELECT category, string_agg(severity || ':' || n, ',' ORDER BY severity) AS counts FROM (SELECT category, severity, count(*) AS n FROM a WHERE resolved_at IS NULL GROUP BY 1, 2) GROUP BY 1")
def alerts_by_category(spark, sf_dir):
    grouped = op.by_category(_alerts(spark, sf_dir).where("resolved_at is null"))
    return grouped.select("category", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("counts"))


@query("""SELECT event_type AS category, count(*) AS total, count(*) FILTER (value < 100) AS passed, round(count(*) FILTER (value < 100) * 100.0::DOUBLE / count(*), 6) AS success_percent, arg_max(event_id::VARCHAR, ts) FILTER (value < 100) AS last_passed FROM events GROUP BY 1""")
def run_history(spark, sf_dir):
    runs = _events(spark, sf_dir).select(F.col("kind").alias("category"), F.col("event_id").cast("string").alias("name"), (F.col("value") < 100).alias("passed"), "ts")
    return _round(op.run_history(runs), "success_percent")


@query("""SELECT event_type AS suite, count(*) AS tests, round(count(*) FILTER (100 - user_id % 10 >= 95) * 100.0::DOUBLE / count(*), 6) AS passed_percent, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(user_id)::DOUBLE AS peak FROM events GROUP BY 1""")
def load_report(spark, sf_dir):
    results = _events(spark, sf_dir).select(F.col("kind").alias("suite"), (100 - F.col("user_id") % 10).alias("success_rate"), F.col("value").alias("response_ms"), F.col("user_id").cast("double").alias("throughput"))
    return _round(op.load_report(results), "passed_percent", "mean_ms", "p95", "p99")


@query("""SELECT 'c' || user_id % 5 AS channel, count(*) AS total, count(*) FILTER (event_type <> 'error') AS sent, count(*) FILTER (event_type = 'error') AS failed, round(count(*) FILTER (event_type <> 'error') * 100.0::DOUBLE / count(*), 6) AS success_percent, round(avg(value) FILTER (event_type <> 'error'), 6) AS mean_ms FROM events GROUP BY 1""")
def notification_stats(spark, sf_dir):
    sent = _events(spark, sf_dir).select(F.concat(F.lit("c"), F.col("user_id") % 5).alias("channel"), "ok", F.col("value").alias("ms"))
    return _round(op.channel_stats(sent), "success_percent", "mean_ms")


@query("""WITH s AS (SELECT greatest(1.0, (epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts)))) / 60.0) AS minutes, count(*) AS n, avg(value) AS v, count(*) FILTER (event_type = 'error') AS e FROM events)
SELECT round(n / minutes, 6) AS per_minute, round(v, 6) AS latency, round(e * 100.0::DOUBLE / n, 6) AS error_percent, round((n - e) / (minutes / 60), 6) AS per_hour FROM s""")
def service_metrics(spark, sf_dir):
    return _round(op.service_metrics(_events(spark, sf_dir)), "per_minute", "latency", "error_percent", "per_hour")


@query("""SELECT event_type AS kind, count(*) AS n, CASE WHEN event_type = 'error' THEN 0.0 ELSE 100.0 END::DOUBLE AS success_percent, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def latency_percentiles(spark, sf_dir):
    return _round(op.phase_stats(_events(spark, sf_dir)), "mean", "p95", "p99")


@query("SELECT count(*) AS n, round(avg(value), 6) AS mean_seconds, round(count(*) FILTER (event_type = 'error')::DOUBLE / count(*), 6) AS error_rate FROM events")
def controller_totals(spark, sf_dir):
    return _round(op.totals(_events(spark, sf_dir)), "mean_seconds", "error_rate")


@query("""SELECT status, (SELECT count(*) FROM (SELECT user_id, arg_max(event_type, ts) AS last FROM events GROUP BY 1) WHERE last = status) AS n FROM (SELECT unnest(['view', 'click', 'error', 'signup', 'purchase', 'refund']) AS status)""")
def job_tracker(spark, sf_dir):
    """The last state of each job (user), counted by state; states without a job are zero."""
    jobs = op.latest_per(_events(spark, sf_dir), "user_id", "ts", "event_id").select(F.col("kind").alias("status"))
    return op.status_counts(jobs, ["view", "click", "error", "signup", "purchase", "refund"])


@query(f"WITH {_ALERTS} SELECT count(*) AS total, count(*) FILTER (resolved_at IS NULL) AS active, count(resolved_at) AS resolved, count(*) FILTER (severity = 'critical') AS critical, arg_max(id, ts) AS latest FROM a")
def alert_summary(spark, sf_dir):
    return op.alert_summary(_alerts(spark, sf_dir))


@query("""SELECT 'g' || user_id % 10 AS "group", count(*) AS components, CASE WHEN max(value) >= 300 THEN 'critical' WHEN max(value) >= 250 THEN 'warning' ELSE 'healthy' END AS worst FROM events GROUP BY 1""")
def status_rollup(spark, sf_dir):
    v = F.col("value")
    return op.status_rollup(_events(spark, sf_dir).select(F.concat(F.lit("g"), F.col("user_id") % 10).alias("group"), F.when(v >= 300, "critical").when(v >= 250, "warning").otherwise("healthy").alias("status")))


@query("""WITH d AS (SELECT event_type AS series, ts::DATE::VARCHAR AS x, count(*) AS y FROM events GROUP BY 1, 2) SELECT series, string_agg(x || '=' || y, ',' ORDER BY x) AS points FROM d GROUP BY 1""")
def chart_series(spark, sf_dir):
    grouped = _events(spark, sf_dir).groupBy("kind", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    made = op.chart(grouped, "kind", "day", "n")
    return made.select("series", F.array_join(F.zip_with("labels", "data", lambda x, y: F.concat_ws("=", x, y.cast("string"))), ",").alias("points"))


@query("""SELECT 'system' AS component, event_id AS id, value AS cpu, NULL::DOUBLE AS storage FROM events WHERE event_type = 'click' UNION ALL SELECT 'platform', event_id, NULL, value FROM events WHERE event_type = 'view'""")
def unified_status(spark, sf_dir):
    e = _events(spark, sf_dir)
    return op.unified(e.where("kind = 'click'").select(F.col("event_id").alias("id"), F.col("value").alias("cpu")), e.where("kind = 'view'").select(F.col("event_id").alias("id"), F.col("value").alias("storage")))


@query("SELECT user_id, event_id, event_type AS kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark, sf_dir):
    return op.latest_per(_events(spark, sf_dir), "user_id", "ts", "event_id").select("user_id", "event_id", "kind")


@query(f"""WITH {_ALERTS} SELECT id, severity, category, CASE WHEN severity = 'critical' AND category = 'system' THEN 1 WHEN severity = 'critical' AND category = 'data' THEN 2 WHEN severity = 'critical' THEN 3
  WHEN severity = 'warning' AND category = 'system' THEN 4 WHEN severity = 'warning' THEN 5 ELSE 6 END AS priority FROM a WHERE resolved_at IS NULL""")
def prioritised_alerts(spark, sf_dir):
    return op.prioritised(_alerts(spark, sf_dir).where("resolved_at is null")).select("id", "severity", "category", "priority")


@query("""SELECT user_id, count(*) AS calls, round(avg(value), 6) AS mean, max(value) AS most, round(stddev_samp(value), 6) AS deviation FROM events GROUP BY 1 HAVING avg(value) >= 52 ORDER BY avg(value) DESC, user_id LIMIT 20""")
def slow_items(spark, sf_dir):
    return _round(op.slow(_events(spark, sf_dir), "user_id", "value", 52, 20), "mean", "deviation")


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, kind LIMIT 3")
def top_kinds(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(3)


@query("""WITH g AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap FROM events) SELECT user_id, count(*) AS fetches, count(*) FILTER (gap < 3240) AS too_soon, count(*) FILTER (value > 150) AS slow FROM g GROUP BY 1""")
def arrival_gaps(spark, sf_dir):
    return op.arrivals(_events(spark, sf_dir), "user_id", "ts", 3600, 150, "event_id")


@query("""SELECT event_id, CASE WHEN value < 10 THEN 'faster' WHEN value > 30 THEN 'slower' ELSE 'similar' END AS speed, json_extract(props, '$.k')::INTEGER AS k FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""")
def recent_history(spark, sf_dir):
    """Runs of the last day with their speed class and a JSON path."""
    e = model.table(spark, sf_dir, "events")
    rows = e.crossJoin(model.as_of(e, "ts")).where(F.col("ts") >= F.col("now") - F.expr("INTERVAL 24 HOURS"))
    return rows.select("event_id", F.when(F.col("value") < 10, "faster").when(F.col("value") > 30, "slower").otherwise("similar").alias("speed"), F.get_json_object("props", "$.k").cast("int").alias("k"))


@query(f"""WITH {_ALERTS}, n AS (SELECT max(ts) AS now FROM events), u AS (SELECT count(*) AS samples, count(*) FILTER (event_type = 'error') AS errors, max(value) AS peak, avg(value) AS mean FROM events, n WHERE ts > now - INTERVAL 48 HOUR),
t AS (SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (resolved_at IS NULL) AS open, avg(epoch(date_trunc('second', resolved_at)) - epoch(date_trunc('second', ts))) / 60.0 AS m FROM a, n WHERE ts > now - INTERVAL 48 HOUR)
SELECT samples, errors, peak, round(mean, 6) AS mean, critical, warning, open, round(m, 5) AS minutes_to_resolve, CASE WHEN critical > 0 AND open > 0 THEN 'critical' WHEN warning > 0 THEN 'warning' ELSE 'healthy' END AS status,
  concat_ws(',', CASE WHEN open > 0 THEN 'atender_alertas' END, CASE WHEN errors * 1.0::DOUBLE / samples > 0.15 THEN 'revisar_errores' END, CASE WHEN m > 30 THEN 'reducir_tiempos' END) AS advice FROM u, t""")
def period_report(spark, sf_dir):
    report = op.period_report(_events(spark, sf_dir), _alerts(spark, sf_dir), 48)
    return _round(_round(report, "mean"), "minutes_to_resolve", digits=5)


@query("""WITH m AS (SELECT event_id, ['api_requests_limit', 'edge_function_errors', 'api_latency', 'cpu_usage_percent', 'cache_hit_ratio', 'bandwidth_limit', 'queue'][event_id % 7 + 1] AS metric, ['x', 'materialized_view_stale', 'pg_cron_failed'][event_id % 3 + 1] AS kind, ['daily-backup', 'collect_metrics', 'cleanup_old', 'send'][event_id % 4 + 1] AS job FROM events)
SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'supabase_limit' WHEN 1 THEN 'supabase_edge' WHEN 2 THEN 'supabase_api' WHEN 3 THEN 'system_resource' WHEN 4 THEN 'database_performance' WHEN 5 THEN 'supabase_limit' ELSE 'other' END AS category,
  CASE event_id % 3 WHEN 0 THEN 'other' WHEN 1 THEN 'materialized_view' ELSE 'pg_cron_job' END AS component, CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'monitoring' WHEN 2 THEN 'maintenance' ELSE 'regular' END AS job_class FROM m""")
def log_categories(spark, sf_dir):
    """Metrics, kinds of alerts and names of jobs by their categories."""
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.pmod("event_id", F.lit(len(values))).cast("int"))
    metric, kind, job = pick(["api_requests_limit", "edge_function_errors", "api_latency", "cpu_usage_percent", "cache_hit_ratio", "bandwidth_limit", "queue"]), pick(["x", "materialized_view_stale", "pg_cron_failed"]), pick(["daily-backup", "collect_metrics", "cleanup_old", "send"])
    return _events(spark, sf_dir).select("event_id", op.alert_category(metric).alias("category"), op.component(kind).alias("component"), op.job_class(job).alias("job_class"))


@query("""WITH n AS (SELECT max(ts) AS now FROM events), r AS (SELECT ts, CASE WHEN event_type = 'view' THEN 'request' WHEN event_type = 'purchase' THEN 'pipeline' ELSE 'phase' END AS kind, value, event_type <> 'error' AS ok FROM events)
SELECT kind, count(*) AS n, round(avg(value), 6) AS mean, round(count(*) FILTER (NOT ok) * 100.0::DOUBLE / count(*), 6) AS error_percent FROM r, n WHERE ts > now - INTERVAL 24 HOUR GROUP BY 1""")
def recorded_metrics(spark, sf_dir):
    """Views as requests, purchases as pipeline runs, the rest as phases, recorded in one table and summed over a day."""
    e = _events(spark, sf_dir).withColumns({"path": F.col("user_id"), "job": F.col("user_id"), "phase": F.col("kind")})
    one = op.recorded(e.where("kind = 'view'"), e.where("kind = 'purchase'"), e.where("kind not in ('view', 'purchase')"))
    return _round(op.window_metrics(one, model.table(spark, sf_dir, "events").agg(F.max("ts").alias("now"))), "mean", "error_percent")
