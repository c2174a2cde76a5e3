"""Streaming jobs over event files: error rates, job states, and how streams are fed and drained.

Sources are typed, event time has a watermark, and results go to a sink with a checkpoint in the
shared folder, so a restart goes on where it stopped. Error rates come out when a bucket is
over (append mode), which bounds their state; job states are merged by key into a stored table from each
batch's own rows, without any state in the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgraph.session import names, remove


def source(spark: SparkSession, path: str, moment: str = "ts", watermark: str = "1 hour", files: int = 100) -> DataFrame:
    """A Parquet table as a stream, so many files a batch (which bounds what a key has in one), its moment as a timestamp with a watermark."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, so that it may be one file
    return rows.withColumn(moment, F.col(moment).cast("timestamp")).withWatermark(moment, watermark)


def error_rates(events: DataFrame, bucket: str = "1 minute", least: int = 10, rate: float = 0.10) -> DataFrame:
    """(start, events, errors, rate): buckets with at least `least` events and more than `rate` errors. events: ts, kind."""
    counted = events.groupBy(F.window("ts", bucket).alias("w")).agg(F.count("*").alias("events"), F.count_if(F.col("kind") == "error").alias("errors"))
    share = F.col("errors") / F.col("events")
    return counted.where((F.col("events") >= least) & (share > rate)).select(F.col("w.start").alias("start"), "events", "errors", share.alias("rate"))


def job_states(events: DataFrame, target: str) -> DataFrame:
    """(job, status, created, updated) of a stream of events (job, status, ts), merged batch by batch into versions of a table below target.

    A batch reads the version before it and writes the next, of its number; one that is run again replaces its own.
    """
    spark = events.sparkSession

    def states(rows: DataFrame) -> DataFrame:
        return rows.groupBy("job").agg(F.max_by("status", "updated").alias("status"), F.min("created").alias("created"), F.max("updated").alias("updated"))

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.select("job", "status", F.col("ts").alias("created"), F.col("ts").alias("updated"))
        if number:
            rows = rows.unionByName(batch.sparkSession.read.parquet(f"{target}/versions/{number - 1}"))
        states(rows).write.mode("overwrite").parquet(f"{target}/versions/{number}")
        if number > 1:
            remove(batch.sparkSession, f"{target}/versions/{number - 2}")

    run = events.writeStream.foreachBatch(merge).option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    newest = max((int(n) for n in names(spark, f"{target}/versions")), default=None)
    schema = states(spark.createDataFrame([], events.select("job", "status", F.col("ts").alias("created"), F.col("ts").alias("updated")).schema)).schema
    return spark.createDataFrame([], schema) if newest is None else spark.read.schema(schema).parquet(f"{target}/versions/{newest}")


def slices(rows: DataFrame, folder: str, moment: str, parts: int, closing: str = "30 days") -> None:
    """A table, read by all tasks, as files of a folder in the order of time, for a stream that takes a slice a batch; after the last slice two rows of nulls, later by
    `closing`, so that the watermark passes all others."""
    low, high = rows.agg(F.min(F.unix_micros(F.col(moment).cast("timestamp"))), F.max(F.unix_micros(F.col(moment).cast("timestamp")))).first()
    if low is None:
        rows.write.mode("append").parquet(folder)
        return
    at = F.unix_micros(F.col(moment).cast("timestamp"))
    step = max(1, -(-(high - low + 1) // parts))
    for k in range(parts):
        rows.where((at >= low + k * step) & (at < low + (k + 1) * step)).repartition(1).write.mode("append").parquet(folder)
    for k in (1, 2):  # the first moves the watermark, the second's batch runs with it
        last = F.timestamp_micros(F.lit(high)) + k * F.expr(f"INTERVAL {closing}")
        rows.sparkSession.range(1).select(*[(last if f.name == moment else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields]).write.mode("append").parquet(folder)


def drain(rows: DataFrame, folder: str) -> DataFrame:
    """Runs a stream in append mode over all that is there, and reads what it gave."""
    run = rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")
