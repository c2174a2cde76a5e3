"""The news model on the given tables: facts, entities, mentions, articles and logs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of(df: DataFrame, column: str) -> DataFrame:
    """The latest moment of a table, as one row (now), to broadcast."""
    return F.broadcast(df.agg(F.max(column).alias("now")))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts are orders: id, ingested, occurred, kind, importance (1 to 10), country."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    placed = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")  # nations: a fixed 25 rows
    importance = 11 - 2 * F.substring("o_orderpriority", 1, 1).cast("int")
    return orders.join(placed, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ingested"), F.col("o_orderdate").alias("occurred"),
        F.col("o_orderstatus").alias("kind"), importance.alias("importance"), F.col("n_name").alias("country"),
    )


def dated_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts without their country: no join."""
    importance = 11 - 2 * F.substring("o_orderpriority", 1, 1).cast("int")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ingested"), F.col("o_orderstatus").alias("kind"), importance.alias("importance"))


def mentions(spark: SparkSession, sf_dir: str, entity: str = "l_partkey") -> DataFrame:
    """Which fact names which entity: parts for the graph, suppliers (l_suppkey) for series."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fact_id"), F.col(entity).alias("entity_id")).distinct()


def part_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), (1 + F.pmod("p_size", F.lit(10))).alias("relevance"), F.lit(None).cast("long").alias("merged_into"))


def supplier_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("kind"), F.lit(None).cast("long").alias("merged_into"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("outlet"), F.col("lang").alias("language"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("body"))


#: The same in SQL, as common table expressions.
FACTS = """f AS (SELECT o_orderkey AS id, o_orderdate AS ingested, o_orderdate AS occurred, o_orderstatus AS kind,
  11 - 2 * substr(o_orderpriority, 1, 1)::INTEGER AS importance, n_name AS country
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
DATED = """f AS (SELECT o_orderkey AS id, o_orderdate AS ingested, o_orderstatus AS kind,
  11 - 2 * substr(o_orderpriority, 1, 1)::INTEGER AS importance FROM orders)"""
PART_MENTIONS = "m AS (SELECT DISTINCT l_orderkey AS fact_id, l_partkey AS entity_id FROM lineitem)"
SUPPLIER_MENTIONS = "m AS (SELECT DISTINCT l_orderkey AS fact_id, l_suppkey AS entity_id FROM lineitem)"
