"""Vectors: checks, cosine neighbours (exact, and by lists), and the embedding job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def checks(df: DataFrame, key: str, column: str, dimension: int) -> DataFrame:
    """(key, right_size, finite, zero, norm, mean, least, most, valid) of each vector."""
    v = F.col(column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    named = df.select(key, v.alias("_v"), F.coalesce(F.size(v) == dimension, F.lit(False)).alias("right_size"), F.coalesce(finite, F.lit(False)).alias("finite"))
    total = F.aggregate("_v", F.lit(0.0), lambda s, x: s + x)
    full = named.withColumns({"zero": F.coalesce(F.forall("_v", lambda x: x == 0), F.lit(False)), "norm": norm(F.col("_v")), "mean": F.try_divide(total, F.size("_v")), "least": F.array_min("_v"), "most": F.array_max("_v")})
    return full.withColumn("valid", F.col("right_size") & F.col("finite") & ~F.col("zero")).drop("_v")


def check_totals(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("right_size")).alias("wrong_size"), F.count_if(~F.col("finite")).alias("not_finite"), F.count_if("zero").alias("zero"))


#: Vectors of a shard and queries of a block that meet as matrices.
ROWS = 16384


def _unit(column) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an Arrow column of vectors of one length, divided by their norms."""
    whole = column.combine_chunks()
    x = whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _best(k: int) -> Callable:
    """For cogroups of vectors (id, v) and queries (query_id, q): each query's k most alike, and what ties with the last of them."""

    def search(rows, asked):
        import pyarrow as pa

        ids, names = rows["id"].to_numpy(), asked["query_id"].to_numpy()
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(ids) and len(names):
            x, q = _unit(rows["v"]), _unit(asked["q"])
            parts = []
            for first in range(0, len(names), 512):
                s = q[first : first + 512] @ x.T
                s[names[first : first + 512, None] == ids[None, :]] = -np.inf
                least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -2.0)
                i, j = np.nonzero((s >= least[:, None] - 1e-8) & (s > -np.inf))
                parts.append((names[first + i], ids[j], s[i, j]))
            out = [np.concatenate(p) for p in zip(*parts, strict=True)]
        return pa.table(dict(zip(("query_id", "id", "similarity"), out, strict=True)))

    return search


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")


def _usable(df: DataFrame, key: str, column: str, name: str = "id", vector: str = "v") -> DataFrame:
    rows = df.select(F.col(key).alias(name), F.col(column).cast("array<double>").alias(vector)).where(f"{vector} is not null")
    return rows.where(norm(F.col(vector)) > 0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", rows: int = ROWS) -> DataFrame:
    """(query_id, rank, id, similarity): the k most alike by cosine, exact; null and zero vectors have no part. Vectors have one length.

    Vectors are dealt to shards and queries to blocks of about `rows`; each block meets each shard once, as matrices, and
    gives k rows a query and shard. Both travel by key, so neither side has to fit a broadcast or a task.
    """
    own, asked = _usable(vectors, key, column), _usable(queries, key, column, "query_id", "q")
    shards, blocks = (max(1, -(-df.count() // rows)) for df in (own, asked))
    dealt = own.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    told = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = dealt.groupBy("shard", "block").cogroup(told.groupBy("shard", "block")).applyInArrow(_best(k), "query_id long, id long, similarity double")
    return _ranked(found, k)


def lists(vectors: DataFrame, count: int = 100, key: str = "vec_id", column: str = "embedding", sample: int = 10_000, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """An inverted file: every vector with its nearest of `count` centres, which k-means fits on a bounded sample."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = _usable(vectors, key, column)
    few = rows.orderBy(F.xxhash64("id")).limit(sample).select(array_to_vector("v").alias("features"))
    centres = np.array(KMeans(k=count, seed=seed, maxIter=10).fit(few).clusterCenters())
    return _by_list(rows, centres, 1).withColumn("list", F.col("list")[0]), centres


def _by_list(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """rows (id or query_id, v or q) with list: the nearest centres, as many as probes."""
    name, vector = rows.columns

    def assign(batches):
        import pyarrow as pa

        square = (centres**2).sum(axis=1)
        for b in batches:
            x = b[vector].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, centres.shape[1]))
            near = np.argsort(square[None, :] - 2 * x @ centres.T, axis=1, kind="stable")[:, :probes].astype(np.int32)
            offsets = np.arange(0, near.size + 1, max(1, near.shape[1]), dtype=np.int32)
            yield pa.record_batch({name: b[name], vector: b[vector], "list": pa.ListArray.from_arrays(pa.array(offsets), pa.array(near.ravel()))})

    return rows.mapInArrow(assign, f"{name} long, {vector} array<double>, list array<int>")


def nearest_by_lists(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int = 10, key: str = "vec_id", column: str = "embedding", rows: int = ROWS) -> DataFrame:
    """(query_id, rank, id, similarity) among the vectors of the `probes` lists nearest to each query: approximate.

    A list of many vectors is split, and its queries come in blocks; both meet as matrices.
    """
    sizes = index.groupBy("list").agg(F.ceil(F.count("*") / rows).cast("int").alias("splits"))  # a row a list
    asked = _usable(queries, key, column, "query_id", "q")
    blocks = max(1, -(-asked.count() // rows))
    told = _by_list(asked, centres, probes).withColumn("list", F.explode("list")).join(F.broadcast(sizes), "list").withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
    told = told.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    dealt = index.join(F.broadcast(sizes), "list").withColumn("split", F.pmod(F.xxhash64("id"), F.col("splits")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ("list", "split", "block")
    each = lambda df, *columns: df.select(*[F.col(c).alias(c) for c in (*keys, *columns)])
    found = each(dealt, "id", "v").groupBy(*keys).cogroup(each(told, "query_id", "q").groupBy(*keys)).applyInArrow(_best(k), "query_id long, id long, similarity double")
    return _ranked(found, k)


def hashing_embedder(dimension: int = 64) -> Callable[[pd.Series], list[np.ndarray]]:
    """A stand-in for a model: signed counts of hashed words, of length 1."""

    def embed(texts: pd.Series) -> list[np.ndarray]:
        import zlib

        out = []
        for t in texts:
            v = np.zeros(dimension)
            for w in t.split():
                h = zlib.crc32(w.encode())
                v[h % dimension] += 1 if h >> 31 else -1
            n = np.sqrt((v**2).sum())
            out.append(v / n if n else v)
        return out

    return embed


def embed(df: DataFrame, key: str, text: str, model: Callable[[pd.Series], list], dimension: int = 64) -> DataFrame:
    """(key, embedding, status): vectors by a model over Arrow batches; a text that fails gets zeros and its status."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            filled = b[text].fillna("")
            try:
                vectors, status = model(filled), ["ok"] * len(b)
            except Exception:  # one bad text must not cost its batch
                vectors, status = [], []
                for t in filled:
                    try:
                        vectors.append(model(pd.Series([t]))[0])
                        status.append("ok")
                    except Exception:
                        vectors.append(np.zeros(dimension))
                        status.append("failed")
            status = ["empty" if not t.strip() else s for t, s in zip(filled, status, strict=True)]
            yield pd.DataFrame({key: b[key], "embedding": [np.asarray(v, float) for v in vectors], "status": status})

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<double>, status string")


def embedding_stats(done: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row over (status): rows, succeeded, failed, empty, success_percent, and rows a second if the job's seconds are given."""
    n = F.count("*")
    rate = [(n / F.lit(float(seconds))).alias("per_second")] if seconds else []
    count = lambda s: F.count_if(F.col("status") == s)
    return done.agg(n.alias("rows"), count("ok").alias("succeeded"), count("failed").alias("failed"), count("empty").alias("empty"), F.try_divide(count("ok") * 100.0, n).alias("success_percent"), *rate)


def write_back(stored: DataFrame, done: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """Stored rows with the vectors of a job (key, column, status) where they had none; what failed stays pending."""
    new = done.where("status = 'ok'").select(F.col(key).alias("_key"), F.col(column).alias("_new"))
    return stored.join(new, F.col(key) == F.col("_key"), "left").withColumn(column, F.coalesce(column, "_new")).drop("_key", "_new")
