"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _stars(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (a, b). Every node's neighbours (the larger, or the smaller and itself) are hung on its least neighbour."""
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    hung = both.join(least, "a")
    if large:
        return hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    own = least.select("a", F.col("m").alias("b"))
    return hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(own).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), any orderable type, to (node, root): the least node that each node reaches. Nodes without edges are absent."""
    pairs = common.settle(edges.where("a <> b").select("a", "b").distinct())
    while True:
        step = common.settle(_stars(_stars(pairs, True), False))
        # done when every node hangs on one root and no root hangs on another
        loose = step.groupBy("a").count().where("count > 1").limit(1).count() or step.join(step.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        if not loose:
            break
        pairs = step
    return step.select(F.col("a").alias("node"), F.col("b").alias("root")).union(step.select("b", "b").distinct())
