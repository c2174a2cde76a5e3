"""Registered queries that run as streams over the events table, a slice of time in each micro-batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsgraph.plans import model
from newsgraph.plans.alerts import FLOODS
from newsgraph.plans.monitoring import _ALERTS
from newsgraph.registry import query
from newsgraph.session import shared_dir
from newsgraph.streaming import jobs, joins, keyed

#: Micro-batches that a query's events come in.
SLICES = 4


def _folder(spark):
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _sliced(spark, sf_dir):
    """The folder of the events, cut in slices of time."""
    folder = _folder(spark)
    jobs.slices(model.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value"), folder, "ts", SLICES)
    return folder


def _source(spark, folder):
    return jobs.source(spark, folder, files=1).withColumnRenamed("event_type", "kind")


def _metric():
    """Closing rows have none, but a value, as a null is no partner of a join and is left out below the watermark."""
    return F.coalesce(F.concat(F.lit("m"), F.pmod("user_id", F.lit(7))), F.lit(""))


def _alerts(rows):
    v = F.col("value")
    marked = rows.where("kind in ('error', 'signup') or kind is null")  # without a kind: closing rows
    severity = F.when(v >= 120, "critical").when(v >= 60, "warning").otherwise("info")
    return marked.select(F.col("event_id").alias("id"), "ts", severity.alias("severity"), _metric().alias("metric"), "value")


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS start, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1
HAVING count(*) >= 10 AND count(*) FILTER (event_type = 'error') > 0.1 * count(*)""")
def stream_error_rate(spark, sf_dir):
    """Each bucket comes out once, when it is over."""
    rates = jobs.drain(jobs.error_rates(_source(spark, _sliced(spark, sf_dir)), "1 hour"), _folder(spark))
    return rates.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "events", "errors")


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, event_type AS kind, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT event_id, user_id, kind, n, t AS passed, true AS allowed FROM o WHERE n = 1
UNION ALL SELECT o.event_id, o.user_id, o.kind, o.n, CASE WHEN o.t - passed >= 259200000000 THEN o.t ELSE passed END, o.t - passed >= 259200000000 FROM r JOIN o ON o.user_id = r.user_id AND o.kind = r.kind AND o.n = r.n + 1)
SELECT event_id, user_id, kind FROM r WHERE allowed""")
def stream_dedup(spark, sf_dir):
    """Events whose pair of user and kind wasn't let through in the three days before: repeats within that time go, later ones are back."""
    rows = _source(spark, _sliced(spark, sf_dir)).where("event_id is not null").select("event_id", "user_id", "kind", "ts")
    return jobs.drain(keyed.first_seen(rows, "user_id", "kind", seconds=3 * 86_400, tie="event_id"), _folder(spark)).select("event_id", "user_id", "kind")


@query("SELECT user_id AS job, arg_max(event_type, ts) AS status, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created FROM events GROUP BY 1")
def stream_job_states(spark, sf_dir):
    states = jobs.job_states(_source(spark, _sliced(spark, sf_dir)).where("event_id is not null").select(F.col("user_id").alias("job"), F.col("kind").alias("status"), "ts"), _folder(spark))
    return states.select("job", "status", F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query(FLOODS)
def stream_flood_control(spark, sf_dir):
    """As flood_control, as a stream; the state of a metric goes on from slice to slice."""
    alerts = _alerts(_source(spark, _sliced(spark, sf_dir))).where("id is not null").select("id", "ts", "metric")
    return jobs.drain(keyed.flood_control(alerts, "metric", minutes=600), _folder(spark))


@query(f"""WITH RECURSIVE {_ALERTS}, o AS (SELECT id, metric, epoch_us(ts) AS t, row_number() OVER (PARTITION BY metric ORDER BY ts, id) AS n FROM a),
r AS (SELECT id, metric, n, t AS passed, true AS allowed FROM o WHERE n = 1 UNION ALL SELECT o.id, o.metric, o.n, CASE WHEN o.t - passed >= 7200000000 THEN o.t ELSE passed END, o.t - passed >= 7200000000 FROM r JOIN o ON o.metric = r.metric AND o.n = r.n + 1)
SELECT id, metric, allowed FROM r""")
def stream_throttle(spark, sf_dir):
    alerts = _alerts(_source(spark, _sliced(spark, sf_dir))).where("id is not null").select("id", "ts", "metric")
    return jobs.drain(keyed.throttle(alerts, "metric", 7200), _folder(spark)).select("id", "metric", "allowed")


CHANNELS = [{"channel": "mail", "enabled": True, "days": [1, 2, 3, 4, 5, 6, 7], "from_hour": 0, "to_hour": 24, "per_hour": 1, "cooldown": 30}, {"channel": "chat", "enabled": True, "days": [1, 2, 3, 4, 5], "from_hour": 8, "to_hour": 18, "per_hour": 2, "cooldown": 240}]


@query(f"""WITH RECURSIVE {_ALERTS}, c AS (SELECT * FROM (VALUES ('mail', true, [1, 2, 3, 4, 5, 6, 7], 0, 24, 1, 30), ('chat', true, [1, 2, 3, 4, 5], 8, 18, 2, 240)) v(channel, enabled, days, from_hour, to_hour, per_hour, cooldown)),
o AS (SELECT id, channel, epoch_us(ts) AS t, epoch_us(date_trunc('hour', ts)) AS h, enabled AND list_contains(days, isodow(ts)) AND hour(ts) >= from_hour AND hour(ts) < to_hour AS open, per_hour, cooldown::BIGINT * 60000000 AS wait, row_number() OVER (PARTITION BY channel ORDER BY ts, id) AS n FROM a, c),
r AS (SELECT channel, 0::BIGINT AS n, NULL::BIGINT AS h, 0 AS sent, NULL::BIGINT AS last, NULL::BIGINT AS id, '' AS decision FROM c
UNION ALL SELECT channel, n, h, CASE WHEN d = 'sent' THEN before + 1 ELSE before END, CASE WHEN d = 'sent' THEN t ELSE last END, id, d FROM (
  SELECT o.channel, o.n, o.h, o.t, o.id, r.last, CASE WHEN o.h IS DISTINCT FROM r.h THEN 0 ELSE r.sent END AS before,
    CASE WHEN NOT o.open THEN 'skipped' WHEN CASE WHEN o.h IS DISTINCT FROM r.h THEN 0 ELSE r.sent END >= o.per_hour THEN 'throttled' WHEN o.t - r.last < o.wait THEN 'skipped' ELSE 'sent' END AS d
  FROM r JOIN o ON o.channel = r.channel AND o.n = r.n + 1))
SELECT id, channel, decision FROM r WHERE n > 0""")
def stream_channel_decisions(spark, sf_dir):
    """As channel_cooldowns, as a stream: counts of hours and the last message are the channel's state."""
    alerts = _alerts(_source(spark, _sliced(spark, sf_dir))).where("id is not null").select("id", "ts")
    return jobs.drain(keyed.channel_decisions(alerts, CHANNELS), _folder(spark))


@query(f"""WITH {_ALERTS} SELECT id FROM a WHERE severity = 'warning' AND NOT EXISTS (SELECT 1 FROM a b WHERE b.metric = a.metric AND b.severity = 'critical' AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 2 HOUR)""")
def stream_suppression(spark, sf_dir):
    """As alert_suppression: warnings are a stream, and so are the critical alerts that suppress them."""
    folder = _sliced(spark, sf_dir)
    warnings, active = _alerts(_source(spark, folder)).where("severity = 'warning' or id is null"), _alerts(_source(spark, folder)).where("severity = 'critical' or id is null")
    return jobs.drain(joins.suppressed(warnings.select("id", "ts", "metric"), active.select("ts", "metric"), 7200), _folder(spark)).where("id is not null").select("id")


@query(f"""WITH {_ALERTS}, v AS (SELECT 'm' || (user_id % 7) AS metric, ts, value FROM events WHERE event_type = 'view')
SELECT a.id, strftime(min(v.ts), '%Y-%m-%d %H:%M:%S.%f') AS resolved_at FROM a LEFT JOIN v ON a.metric = v.metric AND v.value <= 30 AND v.ts >= a.ts + INTERVAL 30 MINUTE AND v.ts <= a.ts + INTERVAL 6 HOUR WHERE severity = 'critical' GROUP BY 1""")
def stream_resolution(spark, sf_dir):
    """Critical alerts resolve by the first reading of 30 or less, from half an hour to six hours after them."""
    folder = _sliced(spark, sf_dir)
    alerts = _alerts(_source(spark, folder)).where("severity = 'critical' or id is null").select("id", "ts", "metric", F.lit(30.0).alias("limit"))
    readings = _source(spark, folder).where("kind = 'view' or kind is null").select("ts", _metric().alias("metric"), F.coalesce("value", F.lit(0.0)).alias("value")).where("value <= 30")
    found = jobs.drain(joins.resolved(alerts, readings, 1800, 21_600), _folder(spark))
    return found.where("id is not null").select("id", F.date_format("resolved_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("resolved_at"))
