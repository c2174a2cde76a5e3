"""Neighbours by lists against exact ones, and the embedding job's figures."""

from __future__ import annotations

import numpy as np

from newsgraph.operators import vectors as op
from newsgraph.plans import vectors as plans


def test_recall_as_registered(spark):
    folder = "/root/testdata/sf0.01"
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    exact = {(r.query_id, r.id) for r in op.nearest(vectors, vectors.where("vec_id % 20 = 0"), 10).collect()}
    got = plans.vector_ivf(spark, folder).collect()
    assert len(got) == len(exact) and [r for r in got if r.rank == 1 and r.id == r.query_id] == []
    assert len({(r.query_id, r.id) for r in got} & exact) >= 0.9 * len(exact)


def test_neighbours_in_shards_and_blocks(spark):
    """Small shards, lists that are split, repeated vectors, null and zero ones: what brute force gives."""
    r = np.random.default_rng(1)
    x = np.repeat(r.normal(size=(40, 5)), 3, axis=0)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = x / np.sqrt((x**2).sum(axis=1, keepdims=True))
    similarity = np.round(unit @ unit.T, 9)
    want = [(q, n + 1, i) for q in range(0, 120, 7) for n, i in enumerate([i for i in np.lexsort((np.arange(120), -similarity[q])) if i != q][:4])]
    asked = df.where("vec_id % 7 = 0 or vec_id >= 500")
    assert sorted((r.query_id, r.rank, r.id) for r in op.nearest(df, asked, 4, rows=10).collect()) == want
    index, centres = op.lists(df, 6)
    assert sorted((r.query_id, r.rank, r.id) for r in op.nearest_by_lists(index, centres, asked, 4, 6, rows=10).collect()) == want  # all lists are probed


def test_embedding_figures(spark):
    done = spark.createDataFrame([(1, "ok"), (2, "ok"), (3, "failed"), (4, "empty")], "id long, status string")
    row = op.embedding_stats(done, 2.0).first()
    assert (row["rows"], row.succeeded, row.failed, row.empty, row.success_percent, row.per_second) == (4, 2, 1, 1, 50.0, 2.0)
    assert op.embedding_stats(done.limit(0)).first().success_percent is None
