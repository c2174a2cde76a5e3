"""Sinks: archives, partitioned tables, snapshots with a log, retention, payloads, metric lines."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from newsgraph.session import names, remove, settle

def write_archive(pages: DataFrame, path: str) -> DataFrame:
    """Rows with their raw HTML (columns outlet, day, html, ..) to gzip files by outlet and day, in a folder of this call's own below path; the rows
    without it, with the file that holds it."""
    folder = f"{path}/{uuid.uuid4().hex}"
    pages.write.partitionBy("outlet", "day").option("compression", "gzip").json(folder)
    stored = pages.sparkSession.read.schema(pages.schema).json(folder)
    return stored.withColumn("storage_path", F.col("_metadata.file_path")).drop("html")


#: How the periods of a table's layout are written.
PERIODS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def write_by_period(df: DataFrame, path: str, moment: str, period: str = "month") -> None:
    """Appends to a table laid out by day, month or year of a moment; equal periods go to one writer."""
    df.withColumn(period, F.date_format(moment, PERIODS[period])).repartition(period).write.mode("append").partitionBy(period).parquet(path)


def drop_before(spark: SparkSession, path: str, moment: str, period: str, bound) -> dict[str, list[str]]:
    """Takes rows before a moment out of a table laid out by period: folders of whole periods are removed without being read,
    the bound's own period is written anew (or goes, if nothing of it is left), and later ones aren't touched. (dropped, rewritten) periods."""
    edge = bound.strftime({"day": "%Y-%m-%d", "month": "%Y-%m", "year": "%Y"}[period])
    held = [n.removeprefix(f"{period}=") for n in names(spark, path) if n.startswith(f"{period}=") and n != f"{period}=__HIVE_DEFAULT_PARTITION__"]
    old, rewritten = [p for p in held if p < edge], []
    for p in old:
        remove(spark, f"{path}/{period}={p}")
    if edge in held:
        part = f"{path}/{period}={edge}"
        rows = settle(spark.read.parquet(part).where(F.col(moment) >= F.lit(bound).cast(dict(spark.read.parquet(part).dtypes)[moment])))
        if rows.isEmpty():
            remove(spark, part)
            old.append(edge)
        else:
            rows.write.mode("overwrite").parquet(part)
            rewritten = [edge]
    return {"dropped": old, "rewritten": rewritten}


def replace_periods(df: DataFrame, path: str, column: str) -> None:
    """Writes a table laid out by a column; only the values that df holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def refresh(df: DataFrame, path: str, name: str, before: int | None = None) -> dict:
    """Writes a snapshot and tells what happened: name, status, rows, change, seconds, speed, message."""
    began, seen = time.time(), Observation()
    try:
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
        rows, status, message = seen.get["rows"], "SUCCESS", None
    except Exception as e:  # the log tells of failures; the caller goes on with the next snapshot
        rows, status, message = None, "ERROR", str(e).splitlines()[0]
    seconds = time.time() - began
    change = None if rows is None or before is None else rows - before
    return {"name": name, "status": status, "rows": rows, "change": change, "seconds": seconds, "speed": "faster" if seconds < 5 else "slower" if seconds > 30 else "similar", "message": message}


def refresh_all(snapshots: dict[str, DataFrame], folder: str, before: dict[str, int] | None = None) -> list[dict]:
    """Snapshots in their order; one that fails doesn't stop the others."""
    return [refresh(df, f"{folder}/{name}", name, (before or {}).get(name)) for name, df in snapshots.items()]


def retained(df: DataFrame, moment: str, now: Column, days: int, keep: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and one row with how many are too old. keep: rows that stay whatever their age."""
    old = F.coalesce(F.col(moment) < now - F.make_dt_interval(F.lit(days)), F.lit(False))
    if keep is not None:
        old = old & ~F.coalesce(keep, F.lit(False))
    return df.where(~old), df.agg(F.count_if(old).alias("deleted"))


#: Days that rows of each kind stay, for monitoring tables and for what a dashboard keeps.
RETENTION = {"monitoring": {"metrics": 30, "alerts": 90, "jobs": 7}, "dashboard": {"metrics": 7, "alerts": 30, "jobs": 3}}


def maintained(tables: dict[str, tuple[DataFrame, str]], now: Column, policy: str = "monitoring", open_alert: Column | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables (a frame and its moment) less what their policy lets go, and (name, deleted). Alerts that are open stay whatever their age."""
    kept, told = {}, []
    for name, (df, moment) in tables.items():
        kept[name], deleted = retained(df, moment, now, RETENTION[policy][name], open_alert if name == "alerts" else None)
        told.append(deleted.select(F.lit(name).alias("name"), "deleted"))
    return kept, reduce(DataFrame.unionByName, told)


def finished_jobs(jobs: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Jobs (status, updated) less those that ended, well or not, more than so many minutes ago."""
    old = F.col("updated") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    return jobs.where(~F.coalesce(old & F.col("status").isin("completed", "failed"), F.lit(False)))


def payloads(header: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Header rows with an ordered array of structs per child table, empty where there is none."""
    out = header
    for name, child in children.items():
        columns = [c for c in child.columns if c != key]
        grouped = child.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(grouped, key, "left")
        empty = F.array().cast(grouped.schema[name].dataType)
        out = out.withColumn(name, F.coalesce(name, empty))
    return out


def metric_lines(row: DataFrame) -> DataFrame:
    """A one-row frame of figures as lines: metric, kind, value. *_total count up."""
    each = ", ".join(f"'{c}', cast(`{c}` as double)" for c in row.columns)
    lines = row.select(F.expr(f"stack({len(row.columns)}, {each}) as (metric, value)"))
    return lines.select("metric", F.when(F.col("metric").endswith("_total"), "counter").otherwise("gauge").alias("kind"), "value")
