"""A stored trigram index of entity names, probed by batches of names.

The index is a table with a row for each trigram of each name, bucketed by trigram and kind. A batch's names
bring their rarest trigrams only: of n trigrams a name that is alike from t shares at least ceil(t n),
so any n - ceil(t n) + 1 of them meet every such name. They go to the buckets; what is stored is neither
split into trigrams again nor moved. Names that come later are appended, and so are the
counts by which trigrams are rare (a count that is behind makes a choice worse, never wrong).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsgraph.functions.similarity import codes, jaccard, trigrams
from newsgraph.session import settle


class GramIndex:
    def __init__(self, spark: SparkSession, table: str, path: str, buckets: int = 64) -> None:
        """table: its name in the catalog; path: a folder of the shared store for it and the counts."""
        self.spark, self.table, self.path, self.buckets = spark, table, path.rstrip("/"), buckets

    def append(self, entities: DataFrame) -> None:
        """Adds entities (id, name, kind); of equal names of a kind in one call the least id is kept. The first call makes the table."""
        known = entities.where("name is not null").groupBy("name", "kind").agg(F.min("id").alias("entity"))
        grams = codes(trigrams(F.col("name")))
        rows = known.select("entity", "name", "kind", F.explode(grams).alias("gram"))
        rows.repartition(self.buckets, "gram", "kind").write.mode("append").format("parquet").option("path", f"{self.path}/grams").bucketBy(self.buckets, "gram", "kind").sortBy("gram", "kind").saveAsTable(self.table)
        known.select("kind", F.explode(grams).alias("gram")).groupBy("kind", "gram").agg(F.count("*").alias("n")).write.mode("append").parquet(f"{self.path}/counts")

    def candidates(self, asked: DataFrame, t: float) -> DataFrame:
        """(name, kind, entity, other): stored names of its kind that share one of a name's rarest trigrams. asked: distinct (name, kind)."""
        told = asked.withColumn("_grams", codes(trigrams(F.col("name")))).where(F.size("_grams") > 0)
        told = told.withColumn("_most", F.size("_grams") - F.ceil(F.size("_grams") * F.lit(t) - 1e-9).cast("int") + 1).select("name", "kind", "_most", F.explode("_grams").alias("gram"))
        counts = self.spark.read.parquet(f"{self.path}/counts").groupBy("kind", "gram").agg(F.sum("n").alias("n"))
        rare = Window.partitionBy("name", "kind").orderBy(F.coalesce("n", F.lit(0)), "gram")  # one name's trigrams
        chosen = told.join(counts, ["kind", "gram"], "left").withColumn("_place", F.row_number().over(rare)).where("_place <= _most").select("name", "kind", "gram")
        stored = self.spark.table(self.table).select(F.col("kind").alias("_kind"), F.col("gram").alias("_gram"), "entity", F.col("name").alias("other"))
        met = chosen.join(stored, (F.col("gram") == F.col("_gram")) & (F.col("kind") == F.col("_kind")))
        return met.select("name", "kind", "entity", "other").distinct()

    def resolve(self, names: DataFrame, t: float = 0.3, strictly: bool = False) -> DataFrame:
        """(name, kind, entity, score, is_new): for each distinct (name, kind) the most similar stored entity, ties to the least id."""
        asked = settle(names.select("name", "kind").distinct())
        score = jaccard(codes(trigrams(F.col("name"))), codes(trigrams(F.col("other"))))
        scored = self.candidates(asked, t).withColumn("score", score).where(F.col("score") > t if strictly else F.col("score") >= t)
        best = scored.groupBy(F.col("name").alias("_name"), F.col("kind").alias("_kind")).agg(F.max(F.struct("score", -F.col("entity"))).alias("best"))
        joined = asked.join(best, F.col("name").eqNullSafe(F.col("_name")) & F.col("kind").eqNullSafe(F.col("_kind")), "left")
        return joined.select("name", "kind", (-F.col("best.col2")).alias("entity"), F.coalesce("best.score", F.lit(0.0)).alias("score"), F.col("best").isNull().alias("is_new"))

    def drop(self) -> None:
        """Takes the table out of the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
