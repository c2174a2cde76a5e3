"""Exact top-k search by inner product with dual cover trees.

Top of the data's tree: `roots` centres, picked farthest first from a bounded sample. Every
vector belongs to its nearest root; a root's vectors are dealt to shards of about
`shard_rows`, so one vector that holds a third of all rows fills many shards. Within a shard
the data and the queries that ask for it are each indexed by a cover tree: a node of level l
covers its points within 2^l of its centre, and its children's centres, the node's own among
them, are more than 2^(l-1) apart and cover all its points within that. Node pairs are taken
most promising first; a pair whose best possible score, by centres and covering radii, is
below the query node's worst kth score is pruned.

Two rounds: each query is searched in one shard, of the root whose centre scores highest with
it, and the kth score found there is its bound for the second round, in which it goes only to
those other shards whose covering radius may still beat that. A shard's vectors are copied to
the blocks of queries that ask for it and to no others. Bounds only prune; what is left is
scored in exact integers, and ties are never pruned.

What pruning saves depends on the data. Where vectors lie in clusters, most pairs are never
scored (24 % of them in the test of clustered vectors); where all are about equally far from each other, as
random ones in many dimensions are, a cover tree is a root with single points below it, and
nearly all pairs are scored.

Components are floor(256 * x). Defined results: vectors that are null or hold a null or
non-finite component, and rows without an id, take no part; shorter vectors count as padded
with zeros, and wide ones are taken whole; scores beyond a long are held at its
bounds; equal scores rank by smaller id; rows that repeat a query's id are one query
(the least vector) and never its candidates; repeated candidates count as rows of their
own; an empty table gives an empty table. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K, EVERY = 5, 50
#: Bounds: of the sample that gives the roots, of roots, and sizes of shards and query blocks in rows.
SAMPLE, ROOTS, SHARD_ROWS, QUERY_ROWS = 4096, 512, 2048, 8192
#: Nodes of fewer points have no children.
LEAF = 32
_LEAST = np.iinfo(np.int64).min


class CoverTree:
    """Nodes by number: centre (a row), level, covering radius (what is needed of 2^level), norms, parent, children, and the rows of leaves.

    Points that are alone below a child's centre are kept together, as one leaf of their parent's.
    """

    def __init__(self, points: np.ndarray) -> None:
        self.points = points.astype(np.float64)
        self.centre, self.level, self.radius, self.parent, self.children, self.rows, self.nets = [], [], [], [], [], [], []
        self._grow(np.arange(len(points)), 0, -1)
        self.radius, self.parent = np.array(self.radius), np.array(self.parent)
        self.at = self.points[self.centre]
        self.norm = np.sqrt((self.at**2).sum(axis=1))

    def _add(self, centre: int, radius: float, parent: int, rows) -> int:
        node = len(self.centre)
        for values, value in ((self.centre, centre), (self.level, int(np.ceil(np.log2(radius))) if radius > 0 else None), (self.radius, radius * (1 + 1e-9)), (self.parent, parent), (self.children, []), (self.rows, rows), (self.nets, None)):
            values.append(value)
        if parent >= 0:
            self.children[parent].append(node)
        return node

    def _far(self, rows: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((self.points[rows] - self.points[centre]) ** 2).sum(axis=1))

    def _grow(self, rows: np.ndarray, at: int, parent: int) -> None:
        far = self._far(rows, rows[at])
        node = self._add(int(rows[at]), float(far.max()), parent, None)
        if len(rows) <= LEAF or far.max() == 0:
            self.rows[node] = rows
            return
        reach, x = 2.0 ** (self.level[node] - 1), self.points[rows]
        square = (x**2).sum(axis=1)
        picked, least, nearest = [at], far, np.zeros(len(rows), np.int64)
        while least.max() > reach:  # farthest first: centres are more than `reach` apart
            p = int(least.argmax())
            d = np.sqrt(np.maximum(square + square[p] - 2 * (x @ x[p]), 0)) if len(rows) > 4 * LEAF else self._far(rows, rows[p])
            d[p] = 0
            nearest[d < least] = len(picked)
            least = np.minimum(least, d)
            picked.append(p)
        self.nets[node] = rows[picked]
        order = np.argsort(nearest, kind="stable")
        sizes = np.bincount(nearest, minlength=len(picked))
        ends = np.cumsum(sizes)
        for p, size, end in zip(picked, sizes.tolist(), ends.tolist(), strict=True):
            if size > 1:
                own = order[end - size : end]
                self._grow(rows[own], int(np.flatnonzero(own == p)[0]), node)
        alone = order[ends[sizes == 1] - 1]
        if len(alone):
            self._add(int(rows[at]), float(far[alone].max()), node, rows[alone])


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where they can't round, else in whole numbers of any size."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    limits = np.iinfo(np.int64)
    return np.clip(q.astype(object) @ x.astype(object).T, limits.min + 1, limits.max).astype(np.int64)


def dual_search(query_ids, queries, floor, ids, vectors, k: int):
    """(query row, id, score) of each query's k best in a shard, and how many pairs were scored; floor: a score that the kth best is sure to reach."""
    top, own = CoverTree(queries), CoverTree(vectors)
    scores, names = np.full((len(queries), k), _LEAST), np.full((len(queries), k), np.iinfo(np.int64).max)
    worst, scored = floor.astype(np.float64).copy(), 0
    node_worst = np.full(len(top.centre), -np.inf)

    def update(a: int) -> None:
        """The least worst kth score below a query node, and below those above it."""
        while a >= 0:
            now = worst[top.rows[a]].min() if top.rows[a] is not None else node_worst[top.children[a]].min()
            if now == node_worst[a]:
                return
            node_worst[a], a = now, int(top.parent[a])

    for a in range(len(top.centre) - 1, -1, -1):
        node_worst[a] = worst[top.rows[a]].min() if top.rows[a] is not None else node_worst[top.children[a]].min()

    def bounds(a, b) -> np.ndarray:
        dot = (top.at[a] * own.at[b]).sum(axis=-1)
        return (dot + top.radius[a] * own.norm[b] + own.radius[b] * top.norm[a] + top.radius[a] * own.radius[b]) * (1 + 1e-12) + 1e-9 * np.abs(dot) + 1e-6

    def score(a: int, b: int) -> None:
        nonlocal scored
        mine, theirs = top.rows[a], own.rows[b]
        got = _products(queries[mine], vectors[theirs])
        scored += got.size
        some = (got >= worst[mine][:, None]) & (query_ids[mine][:, None] != ids[theirs][None, :])
        for i in np.flatnonzero(some.any(axis=1)).tolist():
            r = mine[i]
            s, n = np.concatenate([scores[r], got[i][some[i]]]), np.concatenate([names[r], ids[theirs][some[i]]])
            best = np.lexsort((n, ~s))[:k]  # ~s: descending, without overflow
            scores[r], names[r] = s[best], n[best]
            if scores[r][-1] > _LEAST:
                worst[r] = max(worst[r], scores[r][-1])
        update(a)

    stack = [(np.inf, 0, 0)]
    while stack:
        most, a, b = stack.pop()
        if most < node_worst[a]:
            continue
        if top.rows[a] is not None and own.rows[b] is not None:
            score(a, b)
            continue
        if own.rows[b] is None and (top.rows[a] is not None or own.radius[b] >= top.radius[a]):
            below = np.array(own.children[b])
            found = [(most, a, c) for most, c in zip(bounds(a, below).tolist(), below.tolist(), strict=True)]
        else:
            below = np.array(top.children[a])
            found = [(most, c, b) for most, c in zip(bounds(below, b).tolist(), below.tolist(), strict=True)]
        stack += sorted(f for f in found if f[0] >= node_worst[f[1]])  # the most promising is taken first
    row, place = np.nonzero(scores > _LEAST)
    return row, names[row, place], scores[row, place], scored


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array of longs) of the rows that take part."""
    picked = common.take(vectors, vec_id=id_col, e=vector_col).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("e").cast("array<double>").alias("e"))
    odd = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return picked.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~odd).select("vec_id", F.transform("e", lambda x: F.floor(x * 256).cast("long")).alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    import pyarrow as pa

    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = array.value_lengths().to_numpy(zero_copy_only=False) if len(array) else np.zeros(0, np.int64)
    flat = array.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(array), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _nearest(x: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x.astype(np.float64)
    square = (x**2).sum(axis=1)[:, None] - 2 * x @ roots.T + (roots**2).sum(axis=1)[None, :]
    best = square.argmin(axis=1)
    return best, np.sqrt(((x - roots[best]) ** 2).sum(axis=1))


_GROUP = "root int, split int, block int, ids binary, queries binary, floor binary"


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, roots: int = ROOTS, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a condition on the column vec_id that picks the queries."""
    rows = whole_numbers(vectors, id_col, vector_col)
    total = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
    width, blocks = max(1, total.width), max(1, -(-total.q // query_rows))
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()  # `sample` rows at most
    centres = _spread(_matrix(few["v"], width).astype(np.float64), max(1, min(roots, total.n // shard_rows)))

    def survey(batches):
        import pyarrow as pa

        count, reach = np.zeros(len(centres), np.int64), np.zeros(len(centres))
        for batch in batches:
            own, far = _nearest(_matrix(batch["v"], width), centres)
            count += np.bincount(own, minlength=len(centres))
            np.maximum.at(reach, own, far)
        used = np.flatnonzero(count)
        yield pa.record_batch({"root": pa.array(used, pa.int32()), "n": pa.array(count[used]), "radius": pa.array(reach[used])})

    found = rows.mapInArrow(survey, "root int, n long, radius double").groupBy("root").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect() if total.n else []  # a row a root
    shards, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in found:
        shards[r.root], radius[r.root] = -(-r.n // shard_rows), r.radius * (1 + 1e-9)

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            own, _ = _nearest(_matrix(batch["v"], width), centres)
            split = (common.mix(batch["vec_id"].to_numpy().astype(np.uint64)) % shards[own].astype(np.uint64)).astype(np.int32)
            yield pa.record_batch({"root": pa.array(own, pa.int32()), "split": pa.array(split), "vec_id": batch["vec_id"], "v": batch["v"]})

    dealt = common.settle(rows.mapInArrow(deal, "root int, split int, vec_id long, v array<long>"))

    def groups(ids, x, floor, root, split):
        """Rows of a query each and a shard each, packed by shard and block."""
        import pyarrow as pa

        block = (common.mix(ids.astype(np.uint64) + np.uint64(1)) % np.uint64(blocks)).astype(np.int64)
        order = np.lexsort((block, split, root))
        cuts = np.flatnonzero((np.diff(root[order]) != 0) | (np.diff(split[order]) != 0) | (np.diff(block[order]) != 0)) + 1
        parts = [p for p in np.split(order, cuts) if len(p)]
        firsts = np.array([p[0] for p in parts], np.int64)
        packed = [pa.array([values[p].tobytes() for p in parts], pa.binary()) for values in (ids, x, floor)]
        numbers = [pa.array(values[firsts], pa.int32()) for values in (root, split, block)]
        return pa.record_batch(dict(zip(("root", "split", "block", "ids", "queries", "floor"), [*numbers, *packed], strict=True)))

    def home(ids, x) -> tuple[np.ndarray, np.ndarray]:
        """The shard of a query's first round."""
        dots = np.where(shards[None, :] > 0, x.astype(np.float64) @ centres.T, -np.inf)
        root = dots.argmax(axis=1)
        return root, (common.mix(ids.astype(np.uint64) + np.uint64(2)) % shards[root].astype(np.uint64)).astype(np.int64)

    def ask_home(batches):
        for batch in batches:
            if batch.num_rows:
                ids, x = batch["vec_id"].to_numpy(), _matrix(batch["v"], width)
                yield groups(ids, x, np.full(len(ids), -np.inf), *home(ids, x))

    def ask_others(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x, floor = batch["vec_id"].to_numpy(), _matrix(batch["v"], width), batch["floor"].to_numpy(zero_copy_only=False)
            own = x.astype(np.float64)
            bounds = (own @ centres.T + np.sqrt((own**2).sum(axis=1))[:, None] * radius[None, :]) * (1 + 1e-12) + 1e-9 * np.abs(own) @ np.abs(centres).T + 1e-6
            row, root = np.nonzero((bounds >= floor[:, None]) & (shards[None, :] > 0))
            many = shards[root]
            row, root, split = np.repeat(row, many), np.repeat(root, many), common.ranges(np.zeros(len(many), np.int64), many)
            done_root, done_split = home(ids, x)
            left = (root != done_root[row]) | (split != done_split[row])
            row, root, split = row[left], root[left], split[left]
            for first in range(0, len(row), query_rows):
                part = slice(first, first + query_rows)
                yield groups(ids[row[part]], x[row[part]], floor[row[part]], root[part], split[part])

    def search(shard, asked):
        import pyarrow as pa

        if not shard.num_rows or not asked.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
        ids, x = shard["vec_id"].to_numpy(), _matrix(shard["v"], width)
        q_ids, q, floor = (np.concatenate([np.frombuffer(b, t) for b in asked[c].to_pylist()]) for c, t in (("ids", np.int64), ("queries", np.int64), ("floor", np.float64)))
        row, names, scores, _ = dual_search(q_ids, q.reshape(len(q_ids), width), floor, ids, x, k)
        return pa.table({"query_id": q_ids[row], "vec_id": names, "score": scores})

    def answers(asked: DataFrame) -> DataFrame:
        asked = common.settle(asked)
        keys = ("root", "split", "block")
        wanted = common.short(common.settle(asked.select(F.col("root").alias("_root"), F.col("split").alias("_split"), F.col("block").alias("_block")).distinct()))
        copies = dealt.join(wanted, (F.col("root") == F.col("_root")) & (F.col("split") == F.col("_split"))).select("root", "split", F.col("_block").alias("block"), "vec_id", "v")
        return copies.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")

    queries = common.settle(rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")))
    first = common.settle(answers(queries.mapInArrow(ask_home, _GROUP)))
    floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
    bounded = queries.join(floors, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    best = first.unionByName(answers(bounded.mapInArrow(ask_others, _GROUP)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _spread(x: np.ndarray, n: int) -> np.ndarray:
    """n points, each the farthest from those before it."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    picked = [0]
    least = ((x - x[0]) ** 2).sum(axis=1)
    while len(picked) < n and least.max() > 0:
        picked.append(int(least.argmax()))
        least = np.minimum(least, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    return x[picked]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE_SQL = f"""
WITH r AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v, r.v)::BIGINT AS score
  FROM r q JOIN r ON q.vec_id <> r.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""
