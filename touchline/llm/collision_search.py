"""Nearest vectors by collision counting: single projections in sorted arrays, query-centred windows, virtual rehashing.

Rows are dealt into blocks, queries into packs, and each block meets each pack in one task. A block keeps one sorted
array for each projection. For a query all windows have the half-width ``WINDOW * radius`` in every projection; a row
that lies inside the windows of enough projections is verified with its exact cosine. The radius then grows (virtual
rehashing: the same arrays, wider windows, only what is new is counted) until it reaches the distance of the
``k``-th best verified row. Enough is set so that a row as far away as the radius is missed with a chance of at most ``MISS``.
No candidates are capped; where the radius passes the diameter every row left is verified.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.vectors import dimension, finite, matrix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROJECTIONS, WINDOW, MISS = 64, 1.5, 0.02  # at most 255 projections
FIRST, GROWTH = 0.25, 1.25  # first radius, and by how much it grows while fewer than k rows are verified
BLOCK_ROWS, PACK_QUERIES = 8192, 512  # on average; a block holds less than 65,536 rows
RESULT = "query_id {0}, query_key long, vec_id {0}, score double"


def enough(projections: int = PROJECTIONS, window: float = WINDOW, miss: float = MISS) -> int:
    """The most collisions that a row at the radius reaches with a chance of ``1 - miss`` at least."""
    p, below = math.erf(window / math.sqrt(2)), 0.0
    for hits in range(projections + 1):
        below += math.comb(projections, hits) * p**hits * (1 - p) ** (projections - hits)
        if below > miss:
            return max(1, hits)
    return projections


def directions(dims: int, projections: int = PROJECTIONS, seed: int = 17) -> np.ndarray:
    """Seeded random directions, orthogonal within runs of ``dims``, so scaled that a unit vector has projections of variance 1."""
    rng = np.random.default_rng(seed)
    runs = [np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(-(-projections // max(dims, 1)))]
    return np.concatenate(runs, 1)[:, :projections] * math.sqrt(dims)


class Block:
    """Rows of a block with one sorted array for each projection."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, axes: np.ndarray):
        self.ids, self.rows, self.axes = ids, rows, axes
        self.norms = np.sqrt((rows * rows).sum(1))
        along = (rows / self.norms[:, None]) @ axes
        order = np.argsort(along, axis=0, kind="stable")
        self.order = np.ascontiguousarray(order.T)
        self.values = np.ascontiguousarray(np.take_along_axis(along, order, 0).T)
        self.places = np.argsort(self.order, axis=1).astype(np.uint16)  # of every row in the sorted arrays

    def _windows(self, at: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place (exclusive) of each query's window in each sorted array."""
        low, high = np.empty(at.shape, np.int64), np.empty(at.shape, np.int64)
        for j, values in enumerate(self.values):
            low[:, j] = np.searchsorted(values, at[:, j] - reach)
            high[:, j] = np.searchsorted(values, at[:, j] + reach, side="right")
        return low, high

    def _wider(self, hits: np.ndarray, begin: list[int], low: list[int], high: list[int], end: list[int]) -> np.ndarray:
        """Collisions of all rows once the windows from ``low`` to ``high`` reach from ``begin`` to ``end``."""
        more = sum(low) - sum(begin) + sum(end) - sum(high)
        if more * 16 > self.order.size:  # so much is new that asking every row for its places is less work than walking the arrays
            return (self.places - np.array(begin, np.uint16)[:, None] < (np.array(end) - begin).astype(np.uint16)[:, None]).sum(0, dtype=np.uint8)
        new = [o[x:y] for o, b, lo, hi, e in zip(self.order, begin, low, high, end, strict=True) for x, y in ((b, lo), (hi, e)) if x < y]
        return hits + np.bincount(np.concatenate(new), minlength=len(hits)).astype(np.uint8) if new else hits

    def nearest(self, names: np.ndarray, queries: np.ndarray, k: int, need: int, window: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and cosines of the ``k`` best rows found for every query, best first, ties to the smaller id."""
        norms = np.sqrt((queries * queries).sum(1))
        at = (queries / norms[:, None]) @ self.axes
        low, _ = self._windows(at, np.zeros(len(at)))
        high = low.copy()
        hits = np.zeros((len(at), len(self.ids)), np.uint8)
        left = self.ids[None, :] != names[:, None]
        radius, reach = np.full(len(at), FIRST), np.full(len(at), np.inf)
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(at)
        active = np.flatnonzero(left.any(1))
        while len(active):
            begin, end = self._windows(at[active], window * radius[active])
            edges = [e.tolist() for e in (begin, low[active], high[active], end)]
            low[active], high[active] = begin, end
            for i, *each in zip(active.tolist(), *edges, strict=True):
                if radius[i] >= 2:  # nothing is farther away: what is left is verified
                    new = np.flatnonzero(left[i])
                else:
                    hits[i] = self._wider(hits[i], *each)
                    new = np.flatnonzero(left[i] & (hits[i] >= need))
                if len(new):
                    left[i, new] = False
                    found, scores = best[i]
                    if len(new) > 4 * k:  # rounding apart, only the k best of the new rows can be among the k best
                        rough = self.rows[new] @ queries[i] / (self.norms[new] * norms[i])
                        new = new[rough >= np.partition(rough, -k)[-k] - 1e-9]
                    scores = np.concatenate([scores, (self.rows[new] * queries[i]).sum(1) / (self.norms[new] * norms[i])])
                    found = np.concatenate([found, new])
                    top = np.lexsort((self.ids[found], -scores))[:k]
                    best[i] = found[top], scores[top]
                    if len(top) == k:
                        reach[i] = np.sqrt(max(0.0, 2 - 2 * scores[top[-1]]))
            active = active[(radius[active] < np.minimum(reach[active], 2)) & left[active].any(1)]
            radius[active] = np.minimum(radius[active] * GROWTH, reach[active])
        return best


def _search(dims: int, k: int, projections: int, window: float, miss: float, id_type: str):
    need, axes = enough(projections, window, miss), directions(dims, projections)

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if rows.num_rows and queries.num_rows:
            block = Block(np.array(rows["vec_id"].to_pylist()), matrix(rows["vector"], dims), axes)
            asked = matrix(queries["vector"], dims)
            names = queries["query_id"].to_pylist()
            best = block.nearest(np.array(names), asked, k, need, window)
            for name, key, (found, scores) in zip(names, queries["query_key"].to_pylist(), best, strict=True):
                out[0] += [name] * len(found)
                out[1] += [key] * len(found)
                out[2] += block.ids[found].tolist()
                out[3] += scores.tolist()
        kind = rows.schema.field("vec_id").type
        return pa.table([pa.array(c, t) for c, t in zip(out, (kind, pa.int64(), kind, pa.float64()), strict=True)], ["query_id", "query_key", "vec_id", "score"])

    return run


def usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id``, ``vector`` of the rows that take part: an id, and a vector that is finite and not zero. Repeated rows are one row."""
    vector = F.col("embedding")
    rows = embeddings.filter(F.col("vec_id").isNotNull() & finite(vector)).filter(F.exists(vector, lambda x: x != 0))
    return rows.select("vec_id", vector.alias("vector")).distinct()


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, rows: int | None = None, asked: int | None = None,
           projections: int = PROJECTIONS, window: float = WINDOW, miss: float = MISS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each of ``queries`` the ``k`` rows of ``vectors`` with the largest cosine that are found.

    Both have ``vec_id``, ``vector`` as :func:`usable` gives them. Rows with the id of a query are its own and never its candidates.
    Queries of one id with different vectors are searched one by one and ranked one by one. Equal cosines are ordered
    by the smaller id. Fewer candidates than ``k`` are all returned; tables without rows give none. ``rows`` and ``asked`` only set how many blocks and packs there are.
    """
    dims = dimension(vectors, "vector")
    kind = dict(vectors.dtypes)["vec_id"]
    rows = vectors.count() if rows is None else rows
    asked = queries.count() if asked is None else asked
    blocks, packs = max(1, -(-rows // BLOCK_ROWS)), max(1, -(-asked // PACK_QUERIES))
    key = F.xxhash64("vec_id", "vector")
    left = vectors.select("vec_id", "vector", F.pmod(key, F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(packs - 1))).alias("pack"))
    right = queries.select(F.col("vec_id").alias("query_id"), key.alias("query_key"), "vector", F.pmod(key, F.lit(packs)).cast("int").alias("pack")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = left.groupBy("block", "pack").cogroup(right.groupBy("block", "pack")).applyInArrow(
        _search(dims, k, projections, window, miss, kind), RESULT.format(kind))
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(embeddings: DataFrame, every: int = 50, k: int = 5, **settings) -> DataFrame:
    """:func:`search` of the rows of ``vec_id, embedding`` whose id is divisible by ``every``, against all rows.

    Rows without an id and vectors that are NULL, zero, or hold NULL or non-finite components take no part, neither as
    queries nor as candidates. Vectors of different lengths raise ``ValueError``. Other columns are not read.
    """
    rows = usable(embeddings)
    queries = rows.filter(F.col("vec_id") % every == 0)
    counts = embeddings.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    return search(rows, queries, k, rows=counts[0], asked=counts[1], **settings)
