"""The co-occurrence graph of entities: edges, degrees, centrality, closest partners."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Meetings from which an edge is strong.
STRONG = 5


#: Rows of mentions a partition; their pairs, a few times as many, fit a task's memory whatever the table's size.
ROWS = 400_000


def parts(mentions: DataFrame, rows: int = ROWS) -> int:
    """Partitions for the pairs of a table of mentions: as many as the session's, and more as the table grows."""
    return max(int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-mentions.count() // rows))


def pairs(mentions: DataFrame, facts: DataFrame, n: int) -> DataFrame:
    """(a, b, importance, ingested, ..) of mentions of one fact, dealt to n partitions by the fact, then by the pair.

    Few pairs repeat within a task, so nothing is summed before they are dealt: a sum of nearly all rows would only take memory.
    """
    dealt = mentions.repartition(n, "fact_id")
    left = facts.repartition(n, "fact_id").join(dealt, "fact_id").withColumnRenamed("entity_id", "a")
    return left.join(dealt.withColumnRenamed("entity_id", "b"), "fact_id").where("a < b").drop("fact_id").repartition(n, "a", "b")


def edges(mentions: DataFrame, facts: DataFrame, least: int = 2, n: int | None = None) -> DataFrame:
    """(a, b, meetings, importance, latest) for entities a < b named by at least `least` common facts.

    Mentions are a set, so meetings and distinct facts are one number.
    """
    met = pairs(mentions, facts.select(F.col("id").alias("fact_id"), "importance", "ingested"), n or parts(mentions))
    grouped = met.groupBy("a", "b").agg(F.count("*").alias("meetings"), F.avg("importance").alias("importance"), F.max("ingested").alias("latest"))
    return grouped.where(F.col("meetings") >= least)


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge once for each end, by one pass over the edges."""
    ends = F.array(F.struct(F.col("a").alias("entity"), F.col("b").alias("partner")), F.struct(F.col("b").alias("entity"), F.col("a").alias("partner")))
    rest = [c for c in edges.columns if c not in ("a", "b")]
    return edges.select(F.inline(ends), *rest)


def degrees(edges: DataFrame, strong: int = STRONG) -> DataFrame:
    return both_ways(edges).groupBy("entity").agg(
        F.count("*").alias("degree"), F.count_if(F.col("meetings") >= strong).alias("strong_degree"),
        F.sum("meetings").alias("weight"), F.avg("meetings").alias("strength"),
    )


def centrality_class(score):
    return F.when(score >= 80, "muy_central").when(score >= 60, "central").when(score >= 40, "moderada").when(score >= 20, "periferica").otherwise("aislada")


def centrality(edges: DataFrame, entities: DataFrame, relevant: int = 7) -> DataFrame:
    """Entities that have an edge, or are relevant by themselves, with degree figures, a score of 0 to 100 and its class."""
    known = entities.where("merged_into IS NULL").select("id", "name", "kind", "relevance")
    joined = known.join(degrees(edges), F.col("id") == F.col("entity"), "left").drop("entity").na.fill(0, ["degree", "strong_degree", "weight"]).na.fill(0.0, ["strength"])
    raw = F.col("degree") * 10 + F.col("strong_degree") * 20 + F.col("strength") * 5 + F.col("relevance") * 3
    score = F.round(F.least(F.lit(100), F.greatest(F.lit(0), raw)).cast("decimal(20,6)"), 0).cast("int")
    scored = joined.withColumn("score", score).withColumn("class", centrality_class(F.col("score")))
    return scored.where((F.col("degree") > 0) | (F.col("relevance") >= relevant))


def top_partners(edges: DataFrame, k: int = 5, n: int | None = None) -> DataFrame:
    """(entity, rank, partner, meetings, latest): the k closest, ties to the smaller partner. n: partitions that entities are dealt to."""
    closest = Window.partitionBy("entity").orderBy(F.desc("meetings"), "partner")
    ways = both_ways(edges)
    ranked = (ways.repartition(n, "entity") if n else ways).withColumn("rank", F.row_number().over(closest)).where(F.col("rank") <= k)
    return ranked.select("entity", "rank", "partner", "meetings", "latest")


def partner_lists(edges: DataFrame, entities: DataFrame, k: int = 5, n: int | None = None) -> DataFrame:
    """(entity, partners): an ordered array of at most k structs, cut before it is gathered. n: partitions of all that is dealt."""
    top, known = top_partners(edges, k, n), entities.select(F.col("id").alias("partner"), "name")
    if n:
        top, known = top.repartition(n, "partner"), known.repartition(n, "partner")
    named = top.join(known, "partner")
    item = F.struct("rank", "partner", "name", "meetings")
    return (named.repartition(n, "entity") if n else named).groupBy("entity").agg(F.sort_array(F.collect_list(item)).alias("partners"))
