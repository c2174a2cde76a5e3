"""Streams joined with streams: suppression by active alerts, and alerts that resolve when their metric is back.

Both sides have watermarks and the moments are bound by an interval, so each side's state is what
the interval can still need. An alert without a partner comes out once the watermark has passed its
interval; `closing` rows at the end of a bounded run let the last ones out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _interval(seconds: float) -> Column:
    return F.expr(f"INTERVAL {int(seconds)} SECONDS")  # a literal, from which Spark tells how long state is needed


def _cell(at: Column, seconds: float) -> Column:
    """The stretch of time, so many seconds long, that a moment is in: with it in the key, a row meets the state of two stretches, not of the whole time."""
    return F.floor(F.unix_micros(at) / (1_000_000 * max(1, int(seconds))))


def suppressed(alerts: DataFrame, active: DataFrame, seconds: float) -> DataFrame:
    """Alerts (id, ts, metric, ..) without an active one (ts, metric) of their metric in the time before, as in batch.

    Several active alerts may meet one; only alerts that none meets come out, so each is one row.
    """
    cell = _cell(F.col("ts"), seconds)
    old = active.select(F.col("ts").alias("_ts"), F.col("metric").alias("_metric"), F.explode(F.array(cell, cell + 1)).alias("_old_cell"))
    met = (F.col("metric") == F.col("_metric")) & (F.col("_cell") == F.col("_old_cell")) & (F.col("_ts") <= F.col("ts")) & (F.col("_ts") > F.col("ts") - _interval(seconds))
    return alerts.withColumn("_cell", cell).join(old, met, "left_outer").where("_ts is null").select(*alerts.columns)


def resolved(alerts: DataFrame, samples: DataFrame, least: float, most: float) -> DataFrame:
    """(id, ts, resolved_at): the first sample (ts, metric, value) of an alert's metric (id, ts, metric, limit) that is back at its limit
    or under, from `least` to `most` seconds after it; null if there is none.

    A window of one row's moment makes the alert's id final with the watermark, so each alert comes out once.
    """
    own, cell = _cell(F.col("ts") + _interval(least), int(most) - int(least)), _cell(F.col("ts"), int(most) - int(least))
    later = samples.select(F.col("ts").alias("_ts"), F.col("metric").alias("_metric"), F.col("value").alias("_value"), F.explode(F.array(cell, cell - 1)).alias("_later_cell"))
    back = (F.col("metric") == F.col("_metric")) & (F.col("_cell") == F.col("_later_cell")) & (F.col("_value") <= F.col("limit")) & (F.col("_ts") >= F.col("ts") + _interval(least)) & (F.col("_ts") <= F.col("ts") + _interval(most))
    joined = alerts.select("id", "ts", "metric", "limit", own.alias("_cell")).join(later, back, "left_outer")
    return joined.groupBy("id", "ts").agg(F.min("_ts").alias("resolved_at"))
