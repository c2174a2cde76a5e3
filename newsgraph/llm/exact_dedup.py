"""Exact dedup by a heavy-hitter split.

A Misra-Gries summary finds the digests that may be frequent. Their exact counts and
winners (at most 2 * `summary` rows, whatever the input) are broadcast, so rows of frequent
texts are decided where they are read; only the other digests are shuffled, and a document's
other columns not at all while the losers among those are few enough to be broadcast.

Defined results: a null text counts as empty; texts of any length are hashed whole; an empty
table gives an empty table; of rows with equal text the one with the largest id stays (a
null id is below all others); of repeated rows with that id and text exactly one stays.
Other columns of the input are kept (deduplicate) or not looked at (groups).
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Entries of the Misra-Gries summary. A text with 1.5/summary of all rows or more is always taken for frequent: a task's
#: count falls short by 1/summary of its rows at most, and 1/(2 * summary) of all rows is asked of what is left.
SUMMARY = 1024


def misra_gries(digests: DataFrame, column: str, size: int = SUMMARY) -> DataFrame:
    """Values of a binary column that may be frequent: per task every value of more than 1/size of its rows, with a lower bound of its count."""

    def summarise(batches):
        import pyarrow as pa

        kept: Counter = Counter()
        for batch in batches:
            for x in batch[column].value_counts():
                kept[x["values"].as_py()] += x["counts"].as_py()
            if len(kept) > size:
                cut = sorted(kept.values(), reverse=True)[size]
                kept = Counter({k: n - cut for k, n in kept.items() if n > cut})
        if kept:
            yield pa.record_batch({column: pa.array(kept.keys(), pa.binary()), "n": pa.array(kept.values(), pa.int64())})

    return digests.select(column).mapInArrow(summarise, f"{column} binary, n long")


def _split(digests: DataFrame, summary: int) -> tuple[DataFrame, DataFrame]:
    """Stored digests (doc_id, digest, row) to winners (digest, best, group_size) of frequent digests, broadcast, and to the other rows."""
    rows = digests.count()
    likely = misra_gries(digests, "digest", summary).groupBy("digest").agg(F.sum("n").alias("n"))
    likely = likely.where(F.col("n") * (2 * summary) > rows).orderBy(F.desc("n"), "digest").limit(2 * summary)
    likely = F.broadcast(likely.select("digest"))  # 2 * summary rows of 32 bytes at most
    heavy = F.broadcast(common.settle(_winners(digests.join(likely, "digest", "left_semi"))))  # as many at most
    return heavy, digests.join(heavy.select("digest"), "digest", "left_anti")


def _winners(digests: DataFrame) -> DataFrame:
    return digests.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size"))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    picked = common.take(docs, doc_id=id_col, text=text_col)
    return common.settle(picked.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row")))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", summary: int = SUMMARY) -> DataFrame:
    """For each row: doc_id, keep_id, group_size, kept, text_sha256, heavy (decided without a shuffle)."""
    digests = _digests(docs, id_col, text_col)
    heavy, rest = _split(digests, summary)
    easy = digests.join(heavy, "digest").withColumn("heavy", F.lit(True))
    light = rest.join(_winners(rest), "digest").withColumn("heavy", F.lit(False))
    return easy.unionByName(light).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("best.row") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "heavy",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", summary: int = SUMMARY) -> DataFrame:
    """The rows of `docs` that stay, with all their columns. Losers of frequent texts go where they are read."""
    digests = _digests(docs, id_col, text_col)
    heavy, rest = _split(digests, summary)
    light = _winners(rest).where("group_size > 1").select(F.col("digest").alias("_digest"), F.col("best.doc_id").alias("_best"))
    repeated = common.settle(rest.join(light, F.col("digest") == F.col("_digest")).select("doc_id", "digest", "_best"))
    place = common.identity(F.col("doc_id"), F.col("digest"))
    won = F.col("doc_id").eqNullSafe(F.col("_best"))
    gone = repeated.where(~won).select(*place)
    crowds = digests.join(heavy, "digest").where(F.col("doc_id").eqNullSafe(F.col("best.doc_id")))
    twins = crowds.select(*place).unionByName(repeated.where(won).select(*place)).groupBy("_id", "_none", "_key").count().where("count > 1")
    winners = heavy.select(F.col("digest").alias("_heavy"), F.col("best.doc_id").alias("_best"))

    def keep(rows: DataFrame) -> DataFrame:
        own = F.when(~F.col("_none"), F.col("_id"))
        marked = rows.join(F.broadcast(winners), F.col("_key") == F.col("_heavy"), "left")  # 2 * summary rows at most
        return marked.where(F.col("_heavy").isNull() | own.eqNullSafe(F.col("_best"))).drop("_heavy", "_best")

    return common.prune(docs, gone, twins, id_col, lambda columns: _digest(columns[docs.columns.index(text_col)]), keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.table(spark, sf_dir, "documents")).drop("heavy")


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
