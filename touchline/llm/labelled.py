"""Bounded samples of labelled documents, and the logistic fit of a few features."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; NULL ids are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)), F.lit(0))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, max_chars: int) -> list[tuple[bytes, int]]:
    """Texts and 0/1 labels of up to ``rows`` labelled documents of each class, in a seeded order.

    Only ids with ``learn`` are looked at; texts above ``max_chars`` are left out of the sample (they are scored
    like all others). An id with several labels counts as 1 if any is 1. The ids are at most ``2 * rows``.
    """
    known = labels.filter(F.col(label).isin(0, 1) & learn & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    order = F.xxhash64(F.lit(label), F.col("doc_id"))
    ids = [r for y in (0, 1) for r in known.filter(F.col("label") == y).orderBy(order, "doc_id").limit(rows).collect()]
    if not ids:
        return []
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(r["doc_id"], r["label"]) for r in ids], "_id long, label int")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).filter(F.length("text") <= max_chars).join(
        F.broadcast(wanted), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label").collect()
    return [(r["text"].encode(), r["label"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["text"]))]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton steps for a ridge logistic regression on scaled columns: means, scales and weights (constant first)."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * np.r_[0, w[1:]])
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def probability(x: np.ndarray, fitted: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    mean, scale, w = fitted
    return sigmoid(np.c_[np.ones(len(x)), (x - mean) / scale] @ w)
