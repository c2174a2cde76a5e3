"""Registered queries over reports and dashboards."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsgraph.operators import articles as art
from newsgraph.operators import monitoring as mon
from newsgraph.operators import reports as op
from newsgraph.plans import articles as article_plans
from newsgraph.plans import model
from newsgraph.plans.monitoring import _ALERTS, _WIDE, _alerts, _events, _wide
from newsgraph.registry import query
from newsgraph.session import shared_dir
from newsgraph.sources import sinks

_NOW = "n AS (SELECT max(ts) AS now FROM events)"


def _now(spark, sf_dir):
    return model.table(spark, sf_dir, "events").agg(F.max("ts").alias("now"))


def _samples(spark, sf_dir):
    """Hourly samples; what a platform uses stands in for its requests and its disk."""
    return _wide(spark, sf_dir).select(F.col("hour").alias("ts"), "cpu", "memory", "connections", F.col("storage").alias("api"), (F.col("storage") / 2).alias("storage"), (100 - F.col("storage")).alias("hits"))


@query(f"""WITH {_NOW}, {_WIDE}, {_ALERTS}, u AS (SELECT count(*) AS c, avg(cpu) AS ac, max(cpu) AS pc, avg(memory) AS am, max(memory) AS pm, avg(connections) AS an, max(connections) AS pn, max(storage) AS pa, max(storage / 2) AS ps FROM w, n WHERE hour > now - INTERVAL 72 HOUR),
t AS (SELECT count(*) AS alerts, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(resolved_at) AS resolved,
  avg(epoch(date_trunc('second', coalesce(resolved_at, now))) - epoch(date_trunc('second', ts))) / 3600.0 AS h FROM a, n WHERE ts > now - INTERVAL 72 HOUR)
SELECT round(c * 60 * 100.0 / (72 * 60), 6) AS uptime, round(ac, 6) AS mean_cpu, round(pc, 6) AS peak_cpu, round(am, 6) AS mean_memory, round(pm, 6) AS peak_memory, round(an, 6) AS mean_connections, round(pn, 6) AS peak_connections, round(pa, 6) AS peak_api, round(ps, 6) AS peak_storage,
  alerts, critical, warning, resolved, round(h, 5) AS hours_open, CASE WHEN critical > 0 THEN 'requires_attention' WHEN warning > 0 THEN 'monitoring_recommended' ELSE 'healthy' END AS health,
  CASE WHEN pc > 90 OR pm > 95 THEN 'escalar_recursos,revisar_consultas,optimizar_rendimiento' WHEN pa > 85 OR ps > 85 THEN 'evaluar_plan,reducir_llamadas,revisar_almacenamiento' WHEN alerts > 0 THEN 'resolver_alertas,ajustar_umbrales' ELSE 'sistema_optimo,seguir_monitoreo' END AS advice FROM u, t""")
def executive_report(spark, sf_dir):
    row = op.executive(_samples(spark, sf_dir), _alerts(spark, sf_dir), _now(spark, sf_dir), 72, minutes=60)
    shown = {c: F.round(c, 6) for c in row.columns if c.startswith(("mean", "peak", "uptime"))}
    return row.withColumns(shown | {"hours_open": F.round("hours_open", 5), "advice": F.array_join("advice", ",")})


@query(f"""WITH {_WIDE}, l AS (SELECT hour::DATE AS day, 'cpu' AS resource, cpu AS v, 75 AS w, 90 AS c FROM w UNION ALL SELECT hour::DATE, 'memory', memory, 80, 95 FROM w UNION ALL SELECT hour::DATE, 'connections', connections, 80, 95 FROM w UNION ALL SELECT hour::DATE, 'cache', 100 - storage, 90, 80 FROM w),
g AS (SELECT day, resource, avg(v) AS mean, max(v) AS peak, any_value(w) AS w, any_value(c) AS c FROM l GROUP BY 1, 2)
SELECT day, resource, round(mean, 4) AS mean, round(peak, 4) AS peak, CASE WHEN resource = 'cache' THEN CASE WHEN mean < 80 THEN 'critical' WHEN mean < 90 THEN 'warning' ELSE 'healthy' END WHEN peak >= c THEN 'critical' WHEN peak >= w THEN 'warning' ELSE 'healthy' END AS status FROM g""")
def resource_days(spark, sf_dir):
    return op.resource_days(_samples(spark, sf_dir), "hits").withColumns({c: F.round(c, 4) for c in ("mean", "peak")})


@query(f"""WITH {_ALERTS}, c AS (SELECT ts::DATE AS day, metric, count(*) AS n FROM a GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, metric) AS r FROM c)
SELECT day, string_agg(metric || ':' || n, ',' ORDER BY r) AS top FROM r WHERE r <= 5 GROUP BY 1""")
def top_metrics(spark, sf_dir):
    return mon.top_per(_alerts(spark, sf_dir).withColumn("day", F.to_date("ts")), "day", "metric", 5)


@query(f"""WITH {_NOW}, r AS (SELECT user_id AS job, count(*) AS runs, count(*) FILTER (event_type = 'error') AS failed FROM events, n WHERE ts > now - INTERVAL 24 HOUR GROUP BY 1),
j AS (SELECT c_custkey AS job, c_custkey % 10 <> 0 AS active FROM customer)
SELECT job, coalesce(runs, 0) AS runs, coalesce(failed, 0) AS failed, round((runs - failed) * 100.0::DOUBLE / runs, 6) AS success_percent,
  CASE WHEN NOT active THEN 'disabled' WHEN failed > 3 THEN 'critical' WHEN failed > 0 OR runs IS NULL THEN 'warning' ELSE 'healthy' END AS health FROM j LEFT JOIN r USING (job)""")
def job_day_health(spark, sf_dir):
    """Customers are the jobs; those whose number ends in 0 are switched off."""
    jobs = model.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job"), (F.col("c_custkey") % 10 != 0).alias("active"))
    runs = _events(spark, sf_dir).select(F.col("user_id").alias("job"), F.col("ts").alias("started"), (~F.col("ok")).alias("failed"))
    return op.job_day(jobs, runs, _now(spark, sf_dir)).withColumn("success_percent", F.round("success_percent", 6))


_SNAPSHOTS = f"""{_NOW}, s AS (SELECT user_id AS name, CASE WHEN user_id % 5 = 0 THEN 0 ELSE count(*) END AS rows, (count(*) * CASE WHEN user_id % 7 = 0 THEN 2000000000 ELSE 100 END)::BIGINT AS bytes, CASE WHEN user_id % 11 <> 0 THEN max(ts) END AS refreshed FROM events GROUP BY user_id),
h AS (SELECT *, CASE WHEN rows = 0 OR bytes > 1073741824 THEN 'warning' ELSE 'healthy' END AS status, (epoch(date_trunc('second', now)) - epoch(date_trunc('second', refreshed))) / 3600.0 AS hours FROM s, n)"""


def _snapshots(spark, sf_dir):
    """A snapshot per user: some empty, some large, some never refreshed."""
    u = F.col("user_id")
    grouped = model.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("c"), F.max("ts").alias("t"))
    return grouped.select(u.alias("name"), F.when(u % 5 == 0, 0).otherwise(F.col("c")).alias("rows"), (F.col("c") * F.when(u % 7 == 0, 2_000_000_000).otherwise(100)).cast("long").alias("bytes"), F.when(u % 11 != 0, F.col("t")).alias("refreshed"))


@query(f"""WITH {_SNAPSHOTS} SELECT name, rows, bytes, status, CASE WHEN hours IS NULL THEN 'never' WHEN hours <= 1 THEN 'fresh' WHEN hours <= 24 THEN 'recent' ELSE 'old' END AS age,
  CASE WHEN hours IS NULL THEN 'never_refreshed' WHEN hours <= 2 THEN 'fresh' WHEN hours <= 6 THEN 'acceptable' ELSE 'stale' END AS freshness FROM h""")
def snapshot_status(spark, sf_dir):
    dated = _snapshots(spark, sf_dir).crossJoin(F.broadcast(_now(spark, sf_dir)))
    return op.snapshot_status(dated, F.col("now")).drop("now", "refreshed")


@query(f"""WITH {_SNAPSHOTS}, x AS (SELECT name, 'snapshot_health' AS kind, status AS severity FROM h WHERE status = 'warning' UNION ALL SELECT name, 'snapshot_stale', 'warning' FROM h WHERE hours > 6)
SELECT * FROM x WHERE NOT (name % 3 = 0 AND kind = 'snapshot_stale')""")
def snapshot_alerts(spark, sf_dir):
    """Every third snapshot has an active alert of an hour ago on being stale, every fourth one of three hours ago on its health."""
    now = _now(spark, sf_dir)
    named = op.snapshot_status(_snapshots(spark, sf_dir), F.lit(None).cast("timestamp"))
    ago = lambda h: F.col("now") - F.make_dt_interval(F.lit(0), F.lit(h))
    dated = named.select("name").crossJoin(F.broadcast(now))
    active = dated.where("name % 3 = 0").select("name", F.lit("snapshot_stale").alias("kind"), ago(1).alias("ts")).unionByName(dated.where("name % 4 = 0").select("name", F.lit("snapshot_health").alias("kind"), ago(3).alias("ts")))
    return op.snapshot_alerts(named, active, now)


@query("""WITH s AS (SELECT ts::DATE AS day, count(*) FILTER (event_type = 'error') * 100.0::DOUBLE / count(*) AS rate, avg(value) AS mean, max(value) AS peak FROM events GROUP BY 1),
p AS (SELECT day, 10 - CASE WHEN rate > 25 THEN 3 WHEN rate > 20 THEN 2 WHEN rate > 15 THEN 1 ELSE 0 END - CASE WHEN mean > 20 THEN 2 WHEN mean > 10 THEN 1 ELSE 0 END - CASE WHEN peak > 100 THEN 1 ELSE 0 END AS score FROM s)
SELECT day, 'daily_report_critical' AS kind, 'critical' AS severity FROM p WHERE score < 6""")
def report_alerts(spark, sf_dir):
    return op.report_alerts(mon.daily_report(_events(spark, sf_dir), high_mean=20, mean=10, peak=100))


@query(f"""WITH {_NOW}, j AS (SELECT CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'other' END AS status, (epoch(date_trunc('second', now)) - epoch(date_trunc('second', ts))) / 60.0 AS m FROM events, n)
SELECT status, count(m) AS n, round(max(m), 6) AS oldest, round(min(m), 6) AS newest FROM (SELECT unnest(['pending', 'running', 'completed', 'failed', 'cancelled']) AS status) LEFT JOIN j USING (status) GROUP BY 1""")
def job_ages(spark, sf_dir):
    kind = F.col("kind")
    status = F.when(kind == "click", "pending").when(kind == "view", "running").when(kind == "error", "failed").when(kind == "purchase", "completed").otherwise("other")
    jobs = _events(spark, sf_dir).select(status.alias("status"), "ts")
    return op.status_ages(jobs, ["pending", "running", "completed", "failed", "cancelled"], _now(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("oldest", "newest")})


@query(f"""WITH {_ALERTS}, x AS (SELECT 'all' AS dimension, 'all' AS value, * EXCLUDE (value) FROM a UNION ALL SELECT 'kind', metric, * EXCLUDE (value) FROM a UNION ALL SELECT 'severity', severity, * EXCLUDE (value) FROM a)
SELECT dimension, value, count(*) AS total, count(*) - count(resolved_at) AS active, arg_max(id, (ts, id)) AS latest FROM x GROUP BY 1, 2""")
def alert_listing(spark, sf_dir):
    return op.alert_listing(_alerts(spark, sf_dir).withColumnRenamed("metric", "kind"))


@query(r"""WITH a AS (SELECT regexp_extract(text, '^[^\n]*') AS title, text AS body FROM documents), e AS (SELECT unnest([CASE WHEN trim(title) = '' THEN 'missing_title' END, CASE WHEN trim(body) = '' THEN 'missing_body' END,
  CASE WHEN trim(title) <> '' AND length(trim(title)) < 10 THEN 'short_title' END, CASE WHEN trim(body) <> '' AND length(trim(body)) < 100 THEN 'short_body' END]) AS error FROM a)
SELECT error, count(*) AS n FROM e WHERE error IS NOT NULL GROUP BY 1""")
def error_types(spark, sf_dir):
    return op.errors_by_type(art.split_valid(art.coerce(article_plans._rows(spark, sf_dir)))[1])


@query(f"""WITH {_NOW}, s AS (SELECT user_id, (epoch(date_trunc('second', any_value(now))) - epoch(date_trunc('second', max(ts)))) / 60.0 AS m FROM events, n GROUP BY 1)
SELECT user_id, round(m, 6) AS minutes, CASE WHEN m <= 10 THEN 'fresh' WHEN m <= 30 THEN 'stale' ELSE 'outdated' END AS freshness, CASE WHEN m <= 10 THEN 'healthy' WHEN m <= 30 THEN 'warning' ELSE 'critical' END AS status FROM s""")
def data_freshness(spark, sf_dir):
    return op.data_freshness(_events(spark, sf_dir), "user_id", "ts", _now(spark, sf_dir)).withColumn("minutes", F.round("minutes", 6))


@query("""SELECT event_id, CASE WHEN value * 100 > 5000 THEN 'very_poor' WHEN value * 100 > 1000 THEN 'poor' WHEN value * 100 > 500 THEN 'fair' WHEN value * 100 > 100 THEN 'good' ELSE 'excellent' END AS rating FROM events""")
def query_rating(spark, sf_dir):
    return op.rated(_events(spark, sf_dir).withColumn("value", F.col("value") * 100), "value").select("event_id", "rating")


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') > 5")
def failing_hosts(spark, sf_dir):
    return op.failing_hosts(_events(spark, sf_dir), "user_id", "ok")


@query("SELECT event_id, event_type AS kind, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_row(spark, sf_dir):
    return op.latest(_events(spark, sf_dir), "ts", "event_id").select("event_id", "kind", "value")


@query(f"""WITH {_NOW}, {_WIDE}, {_ALERTS}, j AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1), o AS (SELECT * FROM a WHERE resolved_at IS NULL),
t AS (SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n FROM a, n WHERE ts > now - INTERVAL 24 HOUR GROUP BY 1)
SELECT (SELECT round(cpu, 6) FROM w ORDER BY hour DESC LIMIT 1) AS cpu, (SELECT count(*) FROM j) AS jobs, (SELECT count(*) FROM j WHERE failed > 3) AS critical_jobs, (SELECT count(*) FROM j WHERE failed BETWEEN 1 AND 3) AS warning_jobs,
  (SELECT string_agg(category || ':' || n, ',' ORDER BY category) FROM (SELECT category, count(*) AS n FROM o GROUP BY 1)) AS categories,
  (SELECT string_agg(id::VARCHAR, ',' ORDER BY r) FROM (SELECT id, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, ts DESC, id) AS r FROM o) WHERE r <= 5) AS urgent,
  (SELECT string_agg(hour || '=' || n, ',' ORDER BY hour) FROM t) AS trend""")
def dashboard(spark, sf_dir):
    jobs = mon.job_stats(_events(spark, sf_dir).select(F.col("user_id").alias("job"), F.col("ts").alias("started"), F.col("value").alias("seconds"), (~F.col("ok")).alias("failed")))
    row = op.dashboard(_samples(spark, sf_dir), _alerts(spark, sf_dir), jobs, _now(spark, sf_dir))
    trend = F.zip_with("hours", "counts", lambda h, n: F.concat_ws("=", h, n.cast("string")))
    return row.select(
        F.round("system.cpu", 6).alias("cpu"), F.col("jobs.total").alias("jobs"), F.col("jobs.critical").alias("critical_jobs"), F.col("jobs.warning").alias("warning_jobs"),
        F.array_join(F.transform(F.map_entries("categories"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("categories"), F.array_join(F.transform("urgent", lambda x: x.cast("string")), ",").alias("urgent"), F.array_join(trend, ",").alias("trend"),
    )


@query("""WITH e AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'article' WHEN 'view' THEN 'fragment' ELSE event_type END AS kind FROM events), h AS (SELECT greatest((epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts)))) / 3600.0, 0.01) AS hours FROM e)
SELECT round(hours, 5) AS hours, round((SELECT count(*) FROM e WHERE kind = 'article') / hours, 6) AS articles_hour, round((SELECT count(*) FROM e WHERE kind = 'fragment') / hours, 6) AS fragments_hour,
  (SELECT quantile_disc(value, 0.95) FROM e) AS p95, (SELECT quantile_disc(value, 0.99) FROM e) AS p99,
  (SELECT string_agg(kind || ':' || CASE WHEN kind = 'error' THEN '0.0' ELSE '100.0' END, ',' ORDER BY kind) FROM (SELECT DISTINCT kind FROM e)) AS success FROM h""")
def service_dashboard(spark, sf_dir):
    kind = F.when(F.col("kind") == "purchase", "article").when(F.col("kind") == "view", "fragment").otherwise(F.col("kind"))
    row = op.service_dashboard(_events(spark, sf_dir).withColumn("kind", kind), accuracy=1_000_000)
    return row.withColumns({"hours": F.round("hours", 5), "articles_hour": F.round("articles_hour", 6), "fragments_hour": F.round("fragments_hour", 6), "success": F.array_join(F.transform(F.map_entries("success"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")})


_REPORT = """s AS (SELECT ts::DATE AS day, count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'error') * 100.0::DOUBLE / count(*) AS rate, avg(value) AS mean, max(value) AS peak FROM events GROUP BY 1),
p AS (SELECT *, least(10, greatest(0, 10 - (CASE WHEN rate > 25 THEN 3 WHEN rate > 20 THEN 2 WHEN rate > 15 THEN 1 ELSE 0 END) - (CASE WHEN mean > 51 THEN 2 WHEN mean > 49 THEN 1 ELSE 0 END) - (CASE WHEN peak > 300 THEN 1 ELSE 0 END)))::INTEGER AS score FROM s)"""


@query(f"""WITH {_REPORT} SELECT day, CASE WHEN score >= 8 THEN 'healthy' WHEN score >= 6 THEN 'warning' ELSE 'critical' END AS status, score, total, errors AS critical, peak AS maximum,
  ((rate > 20)::INTEGER + (mean > 51)::INTEGER + (peak > 300)::INTEGER)::INTEGER AS recommendations FROM p""")
def report_list(spark, sf_dir):
    return op.report_list(op.report_rows(mon.daily_report(_events(spark, sf_dir))))


@query(f"""WITH {_REPORT} SELECT day, CASE WHEN day >= DATE '2024-01-15' THEN -1 ELSE score END AS score, total FROM p""")
def report_upsert(spark, sf_dir):
    """Reports of all days are written, and those of some days written again under the same key: theirs alone are replaced."""
    folder = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    reports = mon.daily_report(_events(spark, sf_dir)).select("day", "score", "total")
    sinks.replace_periods(reports, folder, "day")
    sinks.replace_periods(reports.where("day >= '2024-01-15'").withColumn("score", F.lit(-1)), folder, "day")
    return spark.read.parquet(folder).select("day", "score", "total")
