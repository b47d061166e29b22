"""Usable rows of a vector table, and their numbers as numpy arrays inside tasks."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Executors need not have the package installed: the small functions below travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LARGEST = 1 << 27  # scaled components stay below this, so that sums of squares over 64 dimensions fit a long


def finite(vector: Column) -> Column:
    """True where the vector is there and none of its components is NULL, NaN or infinite."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))


def dimension(vectors: DataFrame, column: str) -> int:
    """The number of components, the same in all rows; 0 for a table without rows. Raises ``ValueError`` where rows differ."""
    least, most = vectors.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if least != most:
        raise ValueError(f"vectors have between {least} and {most} components")
    return least or 0


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """The vectors of a batch without NULLs, a row each, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def floored(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * value)`` as 64-bit integers."""
    out = np.floor(values * scale)
    if out.size and np.abs(out).max() >= LARGEST:
        raise ValueError(f"a component is beyond {LARGEST / scale:g}")
    return out.astype(np.int64)
