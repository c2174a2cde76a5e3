"""Registered queries over editorial review."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgraph.operators import articles as art
from newsgraph.operators import review as op
from newsgraph.plans import model
from newsgraph.registry import query


def _facts(spark, sf_dir):
    return model.facts(spark, sf_dir).withColumn("outlet", F.col("kind"))


@query(f"WITH {model.FACTS} SELECT id, importance FROM f WHERE ingested::DATE BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND kind = 'F' AND country = 'NATION_0' AND importance BETWEEN 5 AND 9")
def review_filter(spark, sf_dir):
    return op.review_filter(_facts(spark, sf_dir), "1996-01-01", "1999-12-31", "F", "NATION_0", 5, 9).select("id", "importance")


@query(f"WITH {model.FACTS} SELECT id, ingested::DATE AS day FROM f WHERE importance >= 5 ORDER BY ingested DESC, id LIMIT 50 OFFSET 100")
def review_page(spark, sf_dir):
    rows = op.review_filter(_facts(spark, sf_dir), least=5)
    return op.page(rows, 3, 50, F.desc("ingested"), "id").select("id", F.to_date("ingested").alias("day"))


@query(f"WITH {model.FACTS} SELECT count(*) AS total, ceil(count(*) / 50.0)::BIGINT AS pages, ceil(count(*) / 50.0) > 3 AS has_next, true AS has_previous FROM f WHERE importance >= 5")
def review_page_info(spark, sf_dir):
    return op.page_info(op.review_filter(_facts(spark, sf_dir), least=5), 3, 50)


@query(f"WITH {model.FACTS} SELECT 'outlet' AS field, kind AS value FROM f GROUP BY 2 UNION ALL SELECT 'country', country FROM f GROUP BY 2 UNION ALL SELECT 'least', min(importance)::VARCHAR FROM f UNION ALL SELECT 'most', max(importance)::VARCHAR FROM f")
def filter_options(spark, sf_dir):
    return op.filter_options(_facts(spark, sf_dir))


@query(f"WITH {model.FACTS} SELECT id, source AS outlet, country FROM f LEFT JOIN documents ON doc_id = id")
def facts_with_article(spark, sf_dir):
    rows = op.with_article(_facts(spark, sf_dir).withColumn("article_id", F.col("id")), model.articles(spark, sf_dir))
    return rows.select("id", F.col("article.outlet").alias("outlet"), F.col("country")[0].alias("country"))


@query("""SELECT o_orderkey AS fact, 1 AS editor, CASE WHEN o_orderkey % 2 = 0 THEN 9 ELSE 5 END AS importance FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, 2, 9 FROM orders WHERE o_orderkey % 10 = 0""")
def feedback_upsert(spark, sf_dir):
    """Stored feedback of editor 1, changed for even facts; editor 2 adds some, and some for facts that don't exist."""
    facts = model.dated_facts(spark, sf_dir)
    stored = facts.where("id % 5 <> 0").select(F.col("id").alias("fact"), F.lit(1).alias("editor"), F.lit(5).alias("importance"), F.lit(0).alias("at"))
    change = facts.where("id % 2 = 0").select(F.col("id").alias("fact"), F.when(F.col("id") % 5 == 0, 2).otherwise(1).alias("editor"), F.lit(9).alias("importance"), F.lit(2).alias("at"))
    lost = facts.select((-1 - F.col("id")).alias("fact"), F.lit(1).alias("editor"), F.lit(1).alias("importance"), F.lit(2).alias("at"))
    merged, _ = op.feedback(stored, change.unionByName(change.withColumns({"importance": F.lit(1), "at": F.lit(1)})).unionByName(lost), facts)
    return merged.drop("at")


@query("SELECT doc_id FROM documents WHERE lang = 'fr' AND source = 'src3'")
def equality_filter(spark, sf_dir):
    return art.equal(model.table(spark, sf_dir, "documents"), {"lang": "fr", "source": "src3", "n_chars": None}).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def pending_work(spark, sf_dir):
    vectors = model.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return art.pending(model.table(spark, sf_dir, "documents").select("doc_id").join(vectors, "doc_id", "left")).select("doc_id")
