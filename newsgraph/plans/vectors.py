"""Registered queries over vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgraph.operators import vectors as op
from newsgraph.plans import model
from newsgraph.registry import query

LISTS, PROBES = 100, 50


@query("""SELECT vec_id, len(embedding) = 64 AS right_size, len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AS finite, len(list_filter(embedding, lambda x: x <> 0)) = 0 AS zero,
  round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(list_avg(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS mean, round(list_min(embedding)::DOUBLE, 6) AS least, round(list_max(embedding)::DOUBLE, 6) AS most FROM embeddings""")
def vector_checks(spark, sf_dir):
    found = op.checks(model.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64).drop("valid")
    return found.withColumns({c: F.round(c, 6) for c in ("norm", "mean", "least", "most")})


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.v, v.v) AS similarity FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, id) AS rank FROM s) WHERE rank <= 10""")
def vector_topk(spark, sf_dir):
    vectors = model.table(spark, sf_dir, "embeddings")
    return op.nearest(vectors, vectors.where("vec_id % 20 = 0"), 10).withColumn("similarity", F.round("similarity", 6))


@query()
def vector_ivf(spark, sf_dir):
    """Approximate neighbours by inverted lists: every row indexed, queries with ids divisible by 20. The vectors form no clusters: 10 of 100 lists give a recall of 0.6, 50 one of 0.97."""
    vectors = model.table(spark, sf_dir, "embeddings")
    index, centres = op.lists(vectors, LISTS)
    return op.nearest_by_lists(index, centres, vectors.where("vec_id % 20 = 0"), 10, PROBES)


@query()
def embed_job(spark, sf_dir):
    docs = model.table(spark, sf_dir, "documents")
    done = op.embed(docs, "doc_id", "text", op.hashing_embedder())
    return done.select("doc_id", "status", F.round(op.norm(F.col("embedding")), 6).alias("norm"))


@query("""SELECT doc_id, doc_id % 3 = 0 OR (trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND doc_id % 7 <> 0) AS done FROM documents""")
def embedding_run(spark, sf_dir):
    """Every third document has its vector already; the others are embedded and written back, but for those that the model fails on."""
    docs = model.table(spark, sf_dir, "documents")
    dimension = 16

    def model_of(texts):
        embed = op.hashing_embedder(dimension)
        if texts.str.startswith("FAIL").any():
            raise ValueError("no vector")
        return embed(texts)

    stored = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.array_repeat(F.lit(1.0), dimension)).alias("embedding"))
    todo = docs.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("FAIL"), "text")).otherwise(F.col("text")).alias("text"))
    done = op.embed(todo, "doc_id", "text", model_of, dimension)
    return op.write_back(stored, done, "doc_id").select("doc_id", F.col("embedding").isNotNull().alias("done"))
