"""Registered queries over alert rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgraph.operators import alerts as op
from newsgraph.operators import monitoring as mon
from newsgraph.plans import model
from newsgraph.plans.monitoring import _ALERTS, _alerts, _events, _WIDE, _wide
from newsgraph.registry import query


@query(f"""WITH {_WIDE}, l AS (SELECT hour, 'cpu' AS metric, cpu AS value FROM w UNION ALL SELECT hour, 'memory', memory FROM w UNION ALL SELECT hour, 'storage', storage FROM w UNION ALL SELECT hour, 'connections', connections FROM w),
t AS (SELECT * FROM (VALUES ('cpu', 15.0, 25.0, false), ('memory', 12.0, 20.0, false), ('storage', 3.0, 1.0, true)) v(metric, warning, critical, below)),
j AS (SELECT *, CASE WHEN (below AND value < critical) OR (NOT below AND value > critical) THEN 'critical' WHEN (below AND value < warning) OR (NOT below AND value > warning) THEN 'warning' END AS severity FROM l JOIN t USING (metric))
SELECT strftime(hour, '%Y-%m-%d %H') AS hour, metric, round(value, 6) AS value, severity, (CASE WHEN severity = 'critical' THEN critical ELSE warning END)::DOUBLE AS "limit" FROM j WHERE severity IS NOT NULL""")
def threshold_alerts(spark, sf_dir):
    rules = spark.createDataFrame([("cpu", 15.0, 25.0, "above"), ("memory", 12.0, 20.0, "above"), ("storage", 3.0, 1.0, "below")], "metric string, warning double, critical double, direction string")
    found = op.threshold_alerts(op.long_form(_wide(spark, sf_dir), "hour", ["cpu", "memory", "storage", "connections"]), rules)
    return found.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "metric", F.round("value", 6).alias("value"), "severity", "limit")


@query(f"""WITH {_ALERTS} SELECT id FROM a WHERE severity = 'warning' AND NOT EXISTS (SELECT 1 FROM a b WHERE b.metric = a.metric AND b.severity = 'critical' AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 2 HOUR)""")
def alert_suppression(spark, sf_dir):
    alerts = _alerts(spark, sf_dir)
    return op.suppressed(alerts.where("severity = 'warning'"), alerts.where("severity = 'critical'"), 7200).select("id")


@query(f"""WITH {_ALERTS}, v AS (SELECT 'm' || (user_id % 7) AS metric, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT a.id, v.value AS last_value FROM a ASOF LEFT JOIN v ON a.metric = v.metric AND a.ts >= v.ts""")
def as_of_reading(spark, sf_dir):
    """The newest reading of an alert's metric at its time."""
    readings = _events(spark, sf_dir).where("kind = 'view'").groupBy(F.concat(F.lit("m"), F.pmod("user_id", F.lit(7))).alias("metric"), "ts").agg(F.max("value").alias("value"))
    return op.as_of_join(_alerts(spark, sf_dir).select("metric", "ts", "id"), readings, "metric", "ts", ["value"]).select("id", "last_value")


@query(f"""WITH {_ALERTS}, n AS (SELECT max(ts) AS now FROM events), l AS (SELECT 'm' || (user_id % 7) AS metric, arg_max(value, ts) AS latest FROM events GROUP BY 1)
SELECT id, ts <= now - INTERVAL 30 MINUTE AND coalesce(latest <= 60, false) AS resolved FROM a LEFT JOIN l USING (metric), n WHERE resolved_at IS NULL""")
def auto_resolve(spark, sf_dir):
    events = _events(spark, sf_dir)
    active = _alerts(spark, sf_dir).where("resolved_at is null").withColumn("limit", F.lit(60.0)).crossJoin(model.as_of(events, "ts"))
    samples = events.select(F.concat(F.lit("m"), F.pmod("user_id", F.lit(7))).alias("metric"), "ts", "value")
    return op.resolve_back(active, samples, F.col("now")).select("id", "resolved")


@query(f"""WITH {_ALERTS}, r AS (SELECT * FROM (VALUES ('urgent', ['critical'], NULL), ('some', ['warning', 'critical'], ['m1', 'm2']), ('all', NULL, NULL)) v(rule, severities, metrics))
SELECT id, rule FROM a JOIN r ON (severities IS NULL OR list_contains(severities, severity)) AND (metrics IS NULL OR list_contains(metrics, metric))""")
def rule_matching(spark, sf_dir):
    rules = spark.createDataFrame([("urgent", ["critical"], None), ("some", ["warning", "critical"], ["m1", "m2"]), ("all", None, None)], "rule string, severities array<string>, metrics array<string>")
    return op.matching(_alerts(spark, sf_dir), rules, {"severity": "severities", "metric": "metrics"}).select("id", "rule")


@query(f"""WITH {_ALERTS}, n AS (SELECT max(ts) AS now FROM events), m AS (SELECT id, (epoch(date_trunc('second', now)) - epoch(date_trunc('second', ts))) / 60.0 AS minutes FROM a, n WHERE severity = 'critical'),
l AS (SELECT id, CASE WHEN minutes >= 21600 THEN 3 WHEN minutes >= 14400 THEN 2 WHEN minutes >= 7200 THEN 1 END AS level FROM m) SELECT id, level FROM l WHERE level IS NOT NULL AND NOT (level = 1 AND id % 2 = 0)""")
def escalation(spark, sf_dir):
    """Critical alerts by multiples of five days; those with an even id have been told of at level 1."""
    alerts = _alerts(spark, sf_dir).where("severity = 'critical'")
    history = alerts.where("id % 2 = 0").select("id", F.lit(1).alias("level"))
    return op.escalations(alerts.crossJoin(model.as_of(_events(spark, sf_dir), "ts")), F.col("now"), 7200, history)


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 60 MINUTE, ts, TIMESTAMP '1970-01-01') ORDER BY ts, event_id) <= 1 AS allowed FROM events""")
def rate_limit_window(spark, sf_dir):
    return op.window_limit(_events(spark, sf_dir), ["user_id"], "ts", 1, 60, "event_id").select("event_id", "allowed")


@query("""SELECT event_id, count(*) OVER w AS before, count(*) OVER w < 1 AS allowed FROM (SELECT *, epoch(date_trunc('second', ts))::BIGINT AS s FROM events) WINDOW w AS (PARTITION BY user_id, event_type ORDER BY s RANGE BETWEEN 36000 PRECEDING AND 1 PRECEDING)""")
def rate_limit_trailing(spark, sf_dir):
    return op.trailing_limit(_events(spark, sf_dir), ["user_id", "kind"], "ts", 1, 36000).select("event_id", "before", "allowed")


@query("SELECT event_id FROM events WHERE value > 200")
def latency_alarms(spark, sf_dir):
    v = F.col("value")
    rows = _events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 3 == 0, v).alias("elapsed"), F.when(F.col("event_id") % 3 == 1, v).alias("duration"), F.when(F.col("event_id") % 3 == 2, v).alias("span"))
    return op.latency_alarms(rows, 200).select("event_id")


@query("""WITH m AS (SELECT event_id, event_type = 'error' OR event_type = 'click' AS bad, event_id % 8 AS k FROM events),
l AS (SELECT event_id, k, [['groq_api_failure', 'Groq API timeout'], ['groq_api_failure', 'bad API key'], ['', 'bad API key'], ['supabase_failure', 'Database down'], ['', 'database down'], ['supabase_failure', 'SUPABASE rpc'], ['', 'groceries'], ['groq_api_failure', 'supabase and groq api']][k + 1] AS x FROM m WHERE bad)
SELECT event_id, x[1] AS alarm, 'Error en ' || split_part(x[1], '_', 1) || ': ' || x[2] AS description FROM l WHERE x[1] <> '' UNION ALL SELECT event_id, 'supabase_failure', 'Error en supabase: ' || x[2] FROM l WHERE k = 7""")
def failure_alarms(spark, sf_dir):
    """Errors, and clicks as critical rows, with eight messages; some tell of a service by their type alone, some of none, one of two."""
    k = F.pmod("event_id", F.lit(8)).cast("int")
    messages = ["Groq API timeout", "bad API key", "bad API key", "Database down", "database down", "SUPABASE rpc", "groceries", "supabase and groq api"]
    kinds = [None, "groq_api_error", "other", "supabase_error", None, None, "groq_api_error", None]
    pick = lambda values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), k)
    level = F.when(F.col("kind") == "error", "ERROR").when(F.col("kind") == "click", "CRITICAL").otherwise("INFO")
    return op.failure_alarms(_events(spark, sf_dir).select("event_id", level.alias("level"), pick(messages).alias("message"), pick(kinds).alias("error_type"))).select("event_id", "alarm", "description")


@query("""WITH s AS (SELECT user_id AS job, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1) SELECT job, CASE WHEN failed > 3 THEN 'critical' ELSE 'warning' END AS severity FROM s WHERE failed > 0 AND job % 10 <> 0""")
def job_health_alerts(spark, sf_dir):
    """Jobs whose number ends in 0 have an active alert."""
    jobs = mon.job_stats(_events(spark, sf_dir).select(F.col("user_id").alias("job"), F.col("ts").alias("started"), F.col("value").alias("seconds"), (~F.col("ok")).alias("failed")))
    return op.health_alerts(jobs, jobs.where("job % 10 = 0"))


@query(f"""WITH {_ALERTS}, c AS (SELECT * FROM (VALUES ('mail', true, [1, 2, 3, 4, 5, 6, 7], 0, 24, 1), ('chat', true, [1, 2, 3, 4, 5], 8, 18, 2), ('sms', false, [1, 2, 3, 4, 5, 6, 7], 0, 24, 5)) v(channel, enabled, days, from_hour, to_hour, per_hour)),
j AS (SELECT *, enabled AND list_contains(days, isodow(ts)) AND hour(ts) >= from_hour AND hour(ts) < to_hour AS open FROM a, c), r AS (SELECT *, row_number() OVER (PARTITION BY channel, date_trunc('hour', ts), open ORDER BY ts, id) AS n FROM j)
SELECT id, channel, CASE WHEN NOT open THEN 'skipped' WHEN n > per_hour THEN 'throttled' ELSE 'sent' END AS decision, CASE WHEN severity = 'critical' THEN 'critical_template' ELSE 'generic_template' END AS template FROM r""")
def channel_decisions(spark, sf_dir):
    channels = spark.createDataFrame([("mail", True, [1, 2, 3, 4, 5, 6, 7], 0, 24, 1), ("chat", True, [1, 2, 3, 4, 5], 8, 18, 2), ("sms", False, [1, 2, 3, 4, 5, 6, 7], 0, 24, 5)], "channel string, enabled boolean, days array<int>, from_hour int, to_hour int, per_hour int")
    return op.channel_decisions(_alerts(spark, sf_dir), channels)


@query(f"""WITH RECURSIVE {_ALERTS}, c AS (SELECT * FROM (VALUES ('mail', true, [1, 2, 3, 4, 5, 6, 7], 0, 24, 1, 30), ('chat', true, [1, 2, 3, 4, 5], 8, 18, 2, 240)) v(channel, enabled, days, from_hour, to_hour, per_hour, cooldown)),
o AS (SELECT id, channel, epoch_us(ts) AS t, epoch_us(date_trunc('hour', ts)) AS h, enabled AND list_contains(days, isodow(ts)) AND hour(ts) >= from_hour AND hour(ts) < to_hour AS open, per_hour, cooldown::BIGINT * 60000000 AS wait, severity, row_number() OVER (PARTITION BY channel ORDER BY ts, id) AS n FROM a, c),
r AS (SELECT channel, 0::BIGINT AS n, NULL::BIGINT AS h, 0 AS sent, NULL::BIGINT AS last, NULL::BIGINT AS id, '' AS decision FROM c
UNION ALL SELECT channel, n, h, CASE WHEN d = 'sent' THEN before + 1 ELSE before END, CASE WHEN d = 'sent' THEN t ELSE last END, id, d FROM (
  SELECT o.channel, o.n, o.h, o.t, o.id, r.last, CASE WHEN o.h IS DISTINCT FROM r.h THEN 0 ELSE r.sent END AS before,
    CASE WHEN NOT o.open THEN 'skipped' WHEN CASE WHEN o.h IS DISTINCT FROM r.h THEN 0 ELSE r.sent END >= o.per_hour THEN 'throttled' WHEN o.t - r.last < o.wait THEN 'skipped' ELSE 'sent' END AS d
  FROM r JOIN o ON o.channel = r.channel AND o.n = r.n + 1))
SELECT r.id, r.channel, r.decision, CASE WHEN a.severity = 'critical' THEN 'critical_template' ELSE 'generic_template' END AS template FROM r JOIN a USING (id) WHERE r.n > 0""")
def channel_cooldowns(spark, sf_dir):
    """Channels with a cooldown, which depends on what was sent before."""
    channels = spark.createDataFrame([("mail", True, [1, 2, 3, 4, 5, 6, 7], 0, 24, 1, 30), ("chat", True, [1, 2, 3, 4, 5], 8, 18, 2, 240)], "channel string, enabled boolean, days array<int>, from_hour int, to_hour int, per_hour int, cooldown int")
    return op.channel_decisions(_alerts(spark, sf_dir), channels)


_TEMPLATES = [("cpu page", "system", "critical", "email", 1, True), ("any page", "custom", "critical", "email", 2, True), ("views", "views_jobs", "warning", "email", 3, True), ("old", "system", "warning", "email", 9, False), ("supabase", "supabase", "warning", "slack", 4, True), ("all slack", "custom", "info", "slack", 5, True), ("older slack", "custom", "warning", "slack", 2, True)]


@query(f"""WITH {_ALERTS}, b AS (SELECT id, severity, CASE WHEN metric IN ('m1', 'm2') THEN 'supabase_' || metric ELSE metric END AS metric, CASE WHEN category = 'system' AND value > 40 THEN 'job_' || category ELSE category END AS kind FROM a),
c AS (SELECT *, CASE WHEN metric LIKE '%supabase%' THEN 'supabase' WHEN kind LIKE '%view%' OR kind LIKE '%job%' THEN 'views_jobs' ELSE 'system' END AS class FROM b),
t AS (SELECT * FROM (VALUES {", ".join(str(x).replace("True", "true").replace("False", "false") for x in _TEMPLATES)}) v(name, alert_type, severity, channel_type, created, active) WHERE active),
n AS (SELECT * FROM (VALUES ('mail', 'email'), ('chat', 'slack'), ('sms', 'sms')) v(channel, channel_type))
SELECT id, channel, coalesce((SELECT arg_max(name, created) FROM t WHERE t.channel_type = n.channel_type AND t.severity = c.severity AND (t.alert_type = 'custom' OR t.alert_type = c.class)),
  (SELECT arg_max(name, created) FROM t WHERE t.channel_type = n.channel_type AND t.alert_type = 'custom')) AS template FROM c, n""")
def notification_templates(spark, sf_dir):
    """Templates by class, severity and type of channel, with the generic one and none behind them."""
    kind = F.when((F.col("category") == "system") & (F.col("value") > 40), F.concat(F.lit("job_"), "category")).otherwise(F.col("category"))
    metric = F.when(F.col("metric").isin("m1", "m2"), F.concat(F.lit("supabase_"), "metric")).otherwise(F.col("metric"))
    channels = spark.createDataFrame([("mail", "email"), ("chat", "slack"), ("sms", "sms")], "channel string, channel_type string")
    templates = spark.createDataFrame(_TEMPLATES, "name string, alert_type string, severity string, channel_type string, created int, active boolean")
    return op.chosen_templates(_alerts(spark, sf_dir).select("id", "severity", metric.alias("metric"), kind.alias("kind")), channels, templates)


_ORDERED = f"""{_ALERTS}, o AS (SELECT id, metric, epoch_us(ts) AS t, row_number() OVER (PARTITION BY metric ORDER BY ts, id) AS n FROM a)"""


FLOODS = f"""WITH RECURSIVE {_ORDERED}, r AS (SELECT id, metric, n, t AS start, 1 AS attempts, false AS told, false AS escalates FROM o WHERE n = 1
UNION ALL SELECT o.id, o.metric, o.n, CASE WHEN o.t > start + 36000000000 THEN o.t ELSE start END, CASE WHEN o.t > start + 36000000000 THEN 1 ELSE attempts + 1 END,
  CASE WHEN o.t > start + 36000000000 THEN false ELSE told OR attempts + 1 >= 5 END, o.t <= start + 36000000000 AND NOT told AND attempts + 1 >= 5 FROM r JOIN o ON o.metric = r.metric AND o.n = r.n + 1)
SELECT id, metric, attempts <= 3 AS allowed, escalates FROM r"""


@query(FLOODS)
def flood_control(spark, sf_dir):
    """Three alerts a metric pass in ten hours from the first; the fifth escalates."""
    return op.flood_control(_alerts(spark, sf_dir).select("id", "ts", "metric"), "metric", minutes=600)


@query(f"""WITH RECURSIVE {_ORDERED}, r AS (SELECT id, metric, n, t AS last, true AS allowed FROM o WHERE n = 1
UNION ALL SELECT o.id, o.metric, o.n, CASE WHEN o.t - last >= 3600000000 THEN o.t ELSE last END, o.t - last >= 3600000000 FROM r JOIN o ON o.metric = r.metric AND o.n = r.n + 1)
SELECT id, metric, allowed FROM r""")
def throttle(spark, sf_dir):
    return op.throttle(_alerts(spark, sf_dir).select("id", "ts", "metric"), "metric", 3600)
