"""Tail probabilities of the t and F distributions for result rows."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import DoubleType

# Executors need not have the package installed: the small functions below travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

def _stirling_rest(z: np.ndarray) -> np.ndarray:
    """log Gamma(z) without z log z - z - log(z) / 2 + log(2 pi) / 2, after shifting the argument above 10."""
    rest, x = np.zeros_like(z), z.copy()
    while (low := x < 10).any():
        # the rest falls by (x + 1/2) log1p(1/x) - 1 from x to x + 1
        rest = rest + np.where(low, (x + 0.5) * np.log1p(1 / x) - 1, 0.0)
        x = np.where(low, x + 1, x)
    return rest + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)


def _log1p_less(u: np.ndarray) -> np.ndarray:
    """log(1 + u) - u without cancellation at small u."""
    near = np.abs(u) < 0.05
    v = np.where(near, u, 0.0)
    r = v / (2 + v)
    series = r * (2 * r * r * (1 / 3 + r * r * (1 / 5 + r * r * (1 / 7 + r * r * (1 / 9 + r * r / 11)))) - v)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(near, series, np.log1p(np.where(near, 0.0, u)) - np.where(near, 0.0, u))


def regularised_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    """I_x(a, b) by Lentz's continued fraction of the smaller tail; ``y`` is 1 - x where that is known exactly.

    The fraction settles within a few times sqrt(max(a, b)) steps. A value that has not settled by then is NaN, never
    a sum cut short. The factor before it is taken relative to the mean, so that large degrees lose no digits.
    """
    y = 1 - np.asarray(x, dtype=float) if y is None else y
    x, y, a, b = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (x, y, a, b)))
    flip = x > (a + 1) / (a + b + 2)
    x, y, a, b = np.where(flip, y, x), np.where(flip, x, y), np.where(flip, b, a), np.where(flip, a, b)
    n = a + b
    off = (x * b - y * a) / n  # x less the mean a / n
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(a * _log1p_less(off * n / a) + b * _log1p_less(-off * n / b) + 0.5 * np.log(a / (n * 2 * np.pi) * b)
                       + _stirling_rest(n) - _stirling_rest(a) - _stirling_rest(b)) / a
    tiny = 1e-300
    d = 1 - n * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    c, value, open_ = np.ones_like(x), d.copy(), (x > 0) & (y >= 0)
    steps = int(500 + 20 * np.sqrt(max(1.0, np.max(np.where(np.isfinite(n), n, 0.0), initial=1.0))))
    for m in range(1, steps):
        if not open_.any():
            break
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (n + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            change = c * d
            value = np.where(open_, value * change, value)
        open_ = open_ & (np.abs(change - 1) > 1e-15)
    part = np.where(x <= 0, 0.0, np.where(open_, np.nan, front * value))
    return np.where(flip, 1 - part, part)


@pandas_udf(DoubleType())
def _f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    f, d1, d2 = (s.astype(float) for s in (f, d1, d2))
    ok = f.notna() & (d1 > 0) & (d2 > 0)
    out = pd.Series(np.nan, index=f.index)
    if ok.any():
        whole = d2[ok] + d1[ok] * f[ok]
        v = regularised_beta(d2[ok] / whole, d2[ok] / 2, d1[ok] / 2, d1[ok] * f[ok] / whole)
        out[ok] = v
    return out


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    """P(F > f)."""
    return F.nanvl(_f_tail(f.cast("double"), d1.cast("double"), d2.cast("double")), F.lit(None).cast("double"))


def t_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| > |t|): the square of t is F-distributed with 1 and dof degrees."""
    return f_tail(t * t, F.lit(1.0), dof)
