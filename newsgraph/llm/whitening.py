"""Whitening of embeddings by spectral divide and conquer with polar decompositions.

Each component c becomes the long x = floor(64 * c) + 1000000. The covariance is taken over the
distinct vectors: their sums are exact integers, every vector is centred at the rounded mean
before it is multiplied, and what the rounding leaves is taken off as one exact term. The
executors add up a matrix per batch of vectors; only sums travel.

The small matrix (dimensions x dimensions) is split on the driver: with a shift s, the
orthogonal polar factor U of V - s*I, by the dynamically weighted Halley iteration in its QR
form, gives (U + I) / 2, the projector on the eigenvectors above s. An orthonormal basis of its
range and of the rest gives two smaller matrices, which are split in turn until single
components remain. They are broadcast and the rows are projected where they are read.

Defined results: rows whose vector is null or holds a null, NaN or infinite entry take no part; rows
without an id do; repeated vectors are fitted once and returned for each row; vectors shorter
than the longest count as padded with entries of 0, an empty one too. A
component without variance (its eigenvalue is at the level of rounding) has no whitened value
and isn't returned, so a table of equal vectors, one row or none gives no rows. Entries beyond
a long are held at its bounds. deviation is held at a long's upper bound. Other columns are
not looked at.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Rows of one product of vectors: 64 x 64 sums per so many vectors.
BLOCK = 16384
_EPS = np.finfo(float).eps


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QR-based dynamically weighted Halley steps."""
    n, size = len(a), np.linalg.norm(a, "fro")
    if not size:
        return np.eye(n)
    x, low = a / size, _EPS / n
    for _ in range(12):
        squared = low * low
        d = (4 * (1 - squared) / (squared * squared)) ** (1 / 3) if low < 1 else 0.0
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - squared) / (squared * root))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        step = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        step = (step + step.T) / 2
        low = min(1.0, low * (wa + wb * squared) / (1 + wc * squared))
        moved, x = np.linalg.norm(step - x, "fro"), step
        if moved < 4 * n * _EPS or low == 1.0 and moved < 1e-7:
            break
    return x


def _split(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the eigenvectors of a above the shift and of those below, or None if one side is empty."""
    n = len(a)
    u = polar(a - shift * np.eye(n))
    projector = (u + np.eye(n)) / 2
    k = int(round(np.trace(projector)))
    if not 0 < k < n:
        return None
    start = np.argsort(-np.diag(projector))[:k]  # columns of the projector with most of it
    basis, _ = np.linalg.qr(np.hstack([projector @ projector[:, start], np.eye(n)]))
    for _ in range(2):  # subspace steps: the projector's range comes first
        basis, _ = np.linalg.qr(np.hstack([projector @ basis[:, :k], (np.eye(n) - projector) @ basis[:, k:n]]))
    return basis[:, :k], basis[:, k:n]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix by spectral divide and conquer."""
    a = (a + a.T) / 2
    n, size = len(a), np.linalg.norm(a, "fro")
    vectors, parts = np.eye(n), [(np.arange(n), a)]
    while parts:
        at, m = parts.pop()
        k = len(at)
        if k < 2:
            continue
        mean = np.trace(m) / k
        if np.linalg.norm(m - np.diag(np.diag(m)), "fro") <= 4 * _EPS * size:
            continue  # diagonal already, as single components and multiples of the identity are
        for shift in [np.median(np.diag(m)), mean, *np.linspace(m.diagonal().min(), m.diagonal().max(), 7)[1:-1]]:
            halves = _split(m, shift)
            if halves:
                break
        else:
            # eigenvalues that no shift tells apart: one rotation of the largest entry outside the diagonal, and again
            i, j = np.unravel_index(np.argmax(np.abs(m - np.diag(np.diag(m)))), m.shape)
            angle = 0.5 * np.arctan2(2 * m[i, j], m[j, j] - m[i, i])
            turn = np.eye(k)
            turn[i, i] = turn[j, j] = np.cos(angle)
            turn[i, j], turn[j, i] = np.sin(angle), -np.sin(angle)
            vectors[:, at] = vectors[:, at] @ turn
            parts.append((at, _symmetric(turn.T @ m @ turn)))
            continue
        above, below = halves
        both = np.hstack([above, below])
        vectors[:, at] = vectors[:, at] @ both
        parts.append((at[: above.shape[1]], _symmetric(above.T @ m @ above)))
        parts.append((at[above.shape[1] :], _symmetric(below.T @ m @ below)))
    values = np.einsum("ij,ik,kj->j", vectors, a, vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _symmetric(m: np.ndarray) -> np.ndarray:
    return (m + m.T) / 2


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x of the rows that take part."""
    picked = common.take(df, vec_id=id_col, v=vector_col).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    low, high = -(2.0**63), 2.0**63 - 2.0**12
    return picked.where(F.col("v").isNotNull() & ~odd).select("vec_id", F.transform("v", lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(c * SCALE, F.lit(low)), F.lit(high))), F.lit(-(2**63))), F.lit(2**63 - 1 - OFFSET)) + OFFSET).alias("x"))


def _matrix(column, width: int) -> np.ndarray:
    """Lists of an Arrow array as rows of a matrix, padded with the x of a zero."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    n = len(column)
    if len(values) == n * width:
        return values.reshape(n, width)
    out = np.full((n, width), OFFSET, values.dtype)
    lengths = np.diff(ends, prepend=0)
    out[np.repeat(np.arange(n), lengths), common.ranges(np.zeros(n, np.int64), lengths)] = values
    return out


class Whitening:
    """A fitted whitening: exact sums, eigenvalues and components of the fit list."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float) -> None:
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace
        self.centre = np.array([round(Fraction(s, n)) for s in sums], np.int64) if n else np.zeros(0, np.int64)
        self.rest = [s - n * int(m) for s, m in zip(sums, self.centre, strict=True)]  # n * (mean - centre), exact
        self.error = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """x (rows of longs) by components."""
        d = (x - self.centre).astype(float) - np.array([r / self.n for r in self.rest])
        return d @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """The exact sum of (n*x - S)^2 of each row, held at a long's upper bound."""
        d = x - self.centre
        far = max(1, int(np.abs(d).max(initial=0))) * self.n + max((abs(r) for r in self.rest), default=0)
        if far * far * max(1, x.shape[1]) < 2**63:
            return ((d * self.n - np.array(self.rest, np.int64)) ** 2).sum(axis=1)
        return np.array([min(2**63 - 1, sum((self.n * int(v) - r) ** 2 for v, r in zip(row, self.rest, strict=True))) for row in d], np.int64)


def _sums(distinct: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows and exact sums per dimension: a row per batch and dimension is added up by Spark."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch["x"], width)
            high, low = x >> 31, x & (2**31 - 1)
            total = [int(h) * 2**31 + int(l) for h, l in zip(high.sum(axis=0), low.sum(axis=0), strict=True)]
            yield pa.record_batch({"j": pa.array(np.arange(-1, width, dtype=np.int32)), "s": pa.array([Decimal(t) for t in [batch.num_rows, *total]], pa.decimal128(38, 0))})

    found = {r.j: int(r.s) for r in distinct.mapInArrow(run, "j int, s decimal(38,0)").groupBy("j").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
    return found.get(-1, 0), [found.get(j, 0) for j in range(width)]


def _products(distinct: DataFrame, width: int, rows_of) -> np.ndarray:
    """Sum of r r^T over all rows r of rows_of(x): a matrix per BLOCK of rows is added up by Spark, row by row of the matrix."""

    def run(batches):
        import pyarrow as pa

        total, ready = None, 0
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                d = rows_of(_matrix(batch["x"].slice(k, BLOCK), width))
                total, ready = d.T @ d if total is None else total + d.T @ d, ready + len(d)
        if ready:
            yield pa.record_batch({"i": pa.array(np.repeat(np.arange(len(total), dtype=np.int32), len(total))), "j": pa.array(np.tile(np.arange(len(total), dtype=np.int32), len(total))), "s": pa.array(total.ravel())})

    cells = distinct.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    size = 1 + max((c.i for c in cells), default=-1)
    out = np.zeros((size, size))
    for c in cells:  # a cell for each pair of dimensions
        out[c.i, c.j] = c.s
    return out


def fit(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors, or None if there are none or no component has variance."""
    rows = _vectors(df, id_col, vector_col)
    distinct = common.settle(rows.select("x").distinct())
    width = distinct.agg(F.max(F.size("x"))).first()[0] or 0
    if not width:
        return None
    # short vectors that are equal once padded are one
    short = distinct.where(F.size("x") < width)
    if not short.isEmpty():
        padded = distinct.select(F.concat("x", F.array_repeat(F.lit(OFFSET).cast("long"), F.lit(width) - F.size("x"))).alias("x"))
        distinct = common.settle(padded.distinct())
    n, sums = _sums(distinct, width)
    model = Whitening(n, sums, np.zeros(0), np.zeros((width, 0)), 0.0)
    centre = model.centre
    about = _products(distinct, width, lambda x: (x - centre).astype(float))
    exact = [[(Fraction(about[i, j]) - Fraction(model.rest[i] * model.rest[j], n)) / n for j in range(width)] for i in range(width)]
    v = np.array([[float(c) for c in row] for row in exact])
    values, vectors = eigen(v)
    model.trace = float(sum(exact[i][i] for i in range(width)))
    kept = int((values[:components] > max(width, 16) * _EPS * max(model.trace, 0.0)).sum())
    if not kept:
        return None
    model.values, model.vectors = values[:kept], vectors[:, :kept]
    white = _products(distinct, width, model.whiten)  # the mean of the whitened is 0 by construction; what rounding leaves of it is below the bound
    model.error = float(np.abs(white / n - np.eye(kept)).max())
    return model


def whiten(df: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector that takes part and each component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = _vectors(df, id_col, vector_col)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)

    def run(batches):
        import pyarrow as pa

        width, k = model.vectors.shape
        for batch in batches:
            x = _matrix(batch["x"], width)
            n = len(x)
            yield pa.record_batch({
                "vec_id": batch["vec_id"].take(pa.array(np.repeat(np.arange(n), k))), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), "n": pa.array(np.full(n * k, model.n)), "deviation": pa.array(np.repeat(model.deviations(x), k)),
                "whitened": pa.array(model.whiten(x).ravel()), "explained": pa.array(np.tile(model.values / model.trace, n)), "identity_error": pa.array(np.full(n * k, model.error)),
            })

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return whiten(vectors, fit(vectors))
