"""Snapshots that are refreshed from changes: edges of the entity graph, and daily counts behind the weekly series.

Changes are mentions (fact_id, entity_id) that came and that went. Of the sums, what the facts that
changed add now less what they added before is merged into the stored rows: only the mentions of those facts
are paired, and only the buckets of the changed keys are read and written. A latest moment can't be taken
off, so edges that lost the fact it came from are looked up again, they alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

from newsgraph.operators import graph
from newsgraph.session import settle
from newsgraph.sources.versions import Snapshot

EDGES = StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("meetings", LongType()), StructField("importance", DoubleType()), StructField("latest", TimestampType())])
DAYS = StructType([StructField("entity", LongType()), StructField("day", DateType()), StructField("kind", StringType()), StructField("mentions", LongType()), StructField("importance", DoubleType())])


def edge_store(spark: SparkSession, folder: str, buckets: int = 64) -> Snapshot:
    """Stored edges: importance is the sum over meetings."""
    return Snapshot(spark, folder, ["a", "b"], EDGES, buckets)


def day_store(spark: SparkSession, folder: str, buckets: int = 64) -> Snapshot:
    return Snapshot(spark, folder, ["entity"], DAYS, buckets)


def _pairs(mentions: DataFrame, facts: DataFrame, n: int) -> DataFrame:
    return graph.pairs(mentions, facts.select(F.col("id").alias("fact_id"), "importance", F.col("ingested").cast("timestamp").alias("ingested")), n)


def _edge_sums(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.count("*").alias("meetings"), F.sum(F.col("importance").cast("double")).alias("importance"), F.max("ingested").alias("latest"))


def build_edges(store: Snapshot, mentions: DataFrame, facts: DataFrame) -> int:
    return store.write(_edge_sums(_pairs(mentions, facts, graph.parts(mentions))))


def _touched(mentions: DataFrame, came: DataFrame, went: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions of the facts that changed, before and after."""
    facts = came.select("fact_id").union(went.select("fact_id")).distinct()
    before = settle(mentions.join(facts, "fact_id", "left_semi").select("fact_id", "entity_id"))
    return before, before.join(went.select("fact_id", "entity_id"), ["fact_id", "entity_id"], "left_anti").union(came.select("fact_id", "entity_id")).distinct()


def _buckets(store: Snapshot, changed: DataFrame) -> list[int]:
    return [r.bucket for r in changed.select(store.bucket().alias("bucket")).distinct().collect()]  # no more than the store has


def refresh_edges(store: Snapshot, mentions: DataFrame, facts: DataFrame, came: DataFrame, went: DataFrame) -> dict:
    """A new version of the edges from the mentions before (a set), all facts and the changes; (buckets read, rows read, version)."""
    before, after = _touched(mentions, came, went)
    n = graph.parts(before)
    old, new = _edge_sums(_pairs(before, facts, n)), _edge_sums(_pairs(after, facts, n))
    side = lambda df, sign, most: df.select("a", "b", (sign * F.col("meetings")).alias("meetings"), (sign * F.col("importance")).alias("importance"), *most)
    none = F.lit(None).cast("timestamp")
    delta = side(new, 1, [F.col("latest").alias("came"), none.alias("went")]).union(side(old, -1, [none, F.col("latest")]))
    delta = settle(delta.groupBy("a", "b").agg(F.sum("meetings").alias("dm"), F.sum("importance").alias("di"), F.max("came").alias("came"), F.max("went").alias("went")))
    buckets = _buckets(store, delta)
    stored = store.read(buckets)
    merged = stored.join(delta, ["a", "b"], "full").select(
        "a", "b", (F.coalesce("meetings", F.lit(0)) + F.coalesce("dm", F.lit(0))).alias("meetings"), (F.coalesce("importance", F.lit(0.0)) + F.coalesce("di", F.lit(0.0))).alias("importance"),
        F.greatest("latest", "came").alias("latest"), F.coalesce((F.col("went") >= F.col("latest")) & (F.col("came").isNull() | (F.col("came") < F.col("went"))), F.lit(False)).alias("lost"),
    ).where("meetings > 0")
    merged = settle(merged)
    lost = merged.where("lost").select("a", "b")
    if not lost.isEmpty():
        now = mentions.select("fact_id", "entity_id").join(went.select("fact_id", "entity_id"), ["fact_id", "entity_id"], "left_anti").union(came.select("fact_id", "entity_id")).distinct()
        left = lost.join(now.select(F.col("entity_id").alias("a"), "fact_id"), "a")
        met = left.join(now.select(F.col("entity_id").alias("b"), "fact_id"), ["b", "fact_id"]).join(facts.select(F.col("id").alias("fact_id"), F.col("ingested").cast("timestamp").alias("ingested")), "fact_id")
        found = met.groupBy("a", "b").agg(F.max("ingested").alias("found"))
        merged = merged.join(found, ["a", "b"], "left").withColumn("latest", F.when(F.col("lost"), F.col("found")).otherwise(F.col("latest")))
    rows = stored.count()
    return {"buckets": len(buckets), "rows": rows, "version": store.replace(merged.drop("lost", "found"), buckets)}


def edges(store: Snapshot, least: int = 2) -> DataFrame:
    """(a, b, meetings, importance, latest) as the whole graph's edges are made."""
    return store.read().where(F.col("meetings") >= least).withColumn("importance", F.col("importance") / F.col("meetings"))


def _day_sums(mentions: DataFrame, facts: DataFrame) -> DataFrame:
    rows = mentions.join(facts.select(F.col("id").alias("fact_id"), "importance", "kind", F.to_date("ingested").alias("day")), "fact_id")
    return rows.groupBy(F.col("entity_id").alias("entity"), "day", "kind").agg(F.count("*").alias("mentions"), F.sum(F.col("importance").cast("double")).alias("importance"))


def build_days(store: Snapshot, mentions: DataFrame, facts: DataFrame) -> int:
    return store.write(_day_sums(mentions, facts))


def refresh_days(store: Snapshot, mentions: DataFrame, facts: DataFrame, came: DataFrame, went: DataFrame) -> dict:
    """A new version of the daily counts: sums alone, so nothing is looked up again."""
    before, after = _touched(mentions, came, went)
    sums = lambda df, sign: _day_sums(df, facts).withColumns({"mentions": sign * F.col("mentions"), "importance": sign * F.col("importance")})
    delta = settle(sums(after, 1).union(sums(before, -1)))
    buckets = _buckets(store, delta)
    stored = store.read(buckets)
    merged = stored.union(delta.select(*stored.columns)).groupBy("entity", "day", "kind").agg(F.sum("mentions").alias("mentions"), F.sum("importance").alias("importance")).where("mentions > 0")
    return {"buckets": len(buckets), "rows": stored.count(), "version": store.replace(merged, buckets)}


def weekly(store: Snapshot, entities: DataFrame, now, days: int = 180, least: int = 2) -> DataFrame:
    """(entity, week, mentions, importance, kinds) of the days that the stored counts have since `days` before now (a date)."""
    known = entities.where("merged_into IS NULL").select(F.col("id").alias("entity"))
    recent = store.read().where(F.col("day") >= F.date_sub(now, days)).join(known, "entity", "left_semi")
    grouped = recent.groupBy("entity", F.to_date(F.date_trunc("week", "day")).alias("week"))
    return grouped.agg(F.sum("mentions").alias("mentions"), (F.sum("importance") / F.sum("mentions")).alias("importance"), F.countDistinct("kind").alias("kinds")).where(F.col("mentions") >= least)
