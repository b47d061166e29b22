"""Whitening of vectors: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Components become integers, so that sums and the scatter are exact, whatever the order in which tasks add them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.vectors import dimension, finite, floored, matrix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 64  # x = floor(64 c) + 1000000; the constant leaves every difference and covariance as it is, so floor(64 c) is used
COMPONENTS = 32


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """``L`` (rows in the order of ``scatter``, a column for each pivot) with ``L L' = scatter``; stops where nothing is left."""
    left, factor = np.diag(scatter).astype(float).copy(), np.zeros(scatter.shape)
    least = left.max(initial=0) * len(left) * np.finfo(float).eps
    for k in range(len(left)):
        pivot = int(left.argmax())
        if left[pivot] <= least:
            return factor[:, :k]
        column = (scatter[:, pivot] - factor[:, :k] @ factor[pivot, :k]) / np.sqrt(left[pivot])
        column[left == 0] = 0  # rows that were pivots
        column[pivot] = np.sqrt(left[pivot])
        factor[:, k] = column
        left = np.maximum(left - column**2, 0)
        left[pivot] = 0
    return factor


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Columns of ``factor`` rotated in pairs until all are orthogonal to each other."""
    work = factor.copy()
    for _ in range(sweeps):
        turned = False
        for i in range(work.shape[1] - 1):
            for j in range(i + 1, work.shape[1]):
                a, b, c = work[:, i] @ work[:, i], work[:, j] @ work[:, j], work[:, i] @ work[:, j]
                if abs(c) <= 1e-15 * np.sqrt(a * b):
                    continue
                turned = True
                zeta = (b - a) / (2 * c)
                t = (1.0 if zeta >= 0 else -1.0) / (abs(zeta) + np.hypot(1, zeta))
                cos = 1 / np.hypot(1, t)
                work[:, i], work[:, j] = cos * work[:, i] - cos * t * work[:, j], cos * t * work[:, i] + cos * work[:, j]
        if not turned:
            break
    return work


def components(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size, and unit eigenvectors as columns; only those above zero.

    Column norms of the rotated factor are the roots of the eigenvalues. The sign is set by the largest entry.
    """
    turned = one_sided_jacobi(pivoted_cholesky(covariance))
    values = (turned**2).sum(0)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], turned[:, order] / np.sqrt(values[order])
    if vectors.size:
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1, 1)
    return values, vectors


@dataclass
class Whitening:
    n: int
    sums: list[int]  # of floor(64 c), by dimension
    variance: float  # trace of the covariance
    values: np.ndarray
    vectors: np.ndarray  # a column for each component

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n``, with the whole part of the mean taken off in integers."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return (x - whole) - np.array([s % self.n for s in self.sums], float) / self.n

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over the dimensions of ``(n x - S)^2``, exact; a sum beyond a long raises ``OverflowError``."""
        sums = np.array(self.sums, object)
        if self.n * (int(np.abs(x).max(initial=0)) + max(abs(s) // self.n + 1 for s in self.sums)) < 1 << int(31 - np.log2(len(sums)) / 2):
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1)
        exact = ((self.n * x.astype(object) - sums) ** 2).sum(1)
        if exact.max(initial=0) >= 1 << 63:
            raise OverflowError("a squared deviation is beyond a 64-bit integer")
        return exact.astype(np.int64)


def _upper(vectors: DataFrame, dims: int, numbers) -> dict[tuple[int, int], object]:
    """Sum over all rows of the products of ``numbers(x)`` with themselves (upper triangle): a task adds up its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            z = numbers(floored(matrix(batch.column(0), dims), SCALE))
            total = total + z.T @ z
        if isinstance(total, np.ndarray):
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "s"])

    kind = "long" if numbers(np.zeros((1, dims), np.int64)).dtype == np.int64 else "double"
    found = vectors.select("vector").mapInArrow(run, f"i int, j int, s {kind}").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    return {(r["i"], r["j"]): r["s"] for r in found}


def _sums(vectors: DataFrame, dims: int) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, np.int64)
        for batch in batches:
            x = floored(matrix(batch.column(0), dims), SCALE)
            n, total = n + len(x), total + x.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dims, dtype=np.int32)), pa.array(np.r_[n, total])], ["i", "s"])

    found = {r["i"]: r["s"] for r in vectors.select("vector").mapInArrow(run, "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(dims)]


def fit(vectors: DataFrame, limit: int = COMPONENTS) -> Whitening | None:
    """Up to ``limit`` components of the column ``vector`` over all rows; None without rows or dimensions.

    Two passes: sums, then the scatter of the numbers less the whole part of their mean. What that leaves of the mean
    is taken off in integers on the driver, which holds one triangle of dimensions.
    """
    dims = dimension(vectors, "vector")
    n, sums = _sums(vectors, dims) if dims > 0 else (0, [])
    if not n:
        return None
    whole = np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]  # sum over the rows of x - whole
    scatter = np.zeros((dims, dims))
    for (i, j), s in _upper(vectors, dims, lambda x: x - whole).items():
        scatter[i, j] = scatter[j, i] = (n * s - rest[i] * rest[j]) / n**2  # Python integers up to the division
    values, found = components(scatter)
    return Whitening(n, sums, float(np.trace(scatter)), values[:limit], found[:, :limit])


def identity_error(vectors: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, from one more pass over the rows."""
    error = 0.0
    for (i, j), s in _upper(vectors, len(fitted.sums), fitted.whiten).items():
        error = max(error, abs(s / fitted.n - (i == j)))
    return error


def _rows(fitted: Whitening, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, names = len(fitted.values), ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = floored(matrix(part.column("vector"), len(fitted.sums)), SCALE)
                rows = len(x)
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(rows), many))), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * many, fitted.n)), pa.array(np.repeat(fitted.deviations(x), many)), pa.array(fitted.whiten(x).ravel()),
                    pa.array(np.tile(fitted.values / fitted.variance, rows)), pa.array(np.full(rows * many, error))], names)

    return run


def whiten(embeddings: DataFrame, limit: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every usable row and up to ``limit`` components.

    Rows whose vector is NULL or holds NULL or non-finite components are left out; an empty table gives no rows, and neither do
    vectors that are all equal or empty, as no component has a variance. There are as many components as the covariance
    has ranks, if fewer. NULL ids are kept, repeated rows each count and are returned. Equal eigenvalues keep the order of
    their pivots. Vectors of different lengths or with a component beyond 2,097,151 raise ``ValueError``. Other columns are not read.
    """
    rows = embeddings.filter(finite(F.col("embedding"))).select("vec_id", F.col("embedding").alias("vector"))
    schema = f"vec_id {dict(rows.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit(rows, limit)
    if fitted is None or not len(fitted.values):
        return rows.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(_rows(fitted, identity_error(rows, fitted)), schema)
