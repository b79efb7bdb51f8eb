"""Tail probabilities of t and chi-square as vectorised Pandas UDFs (Spark has no built-in for them)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def _beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (modified Lentz), for x below (a + 1) / (a + b + 2)."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    with np.errstate(divide="ignore"):
        log = _LGAMMA(a + b) - _LGAMMA(a) - _LGAMMA(b) + a * np.log(x) + b * np.log1p(-x)
    return np.exp(log) * h / a


def t_tail(t, df) -> np.ndarray:
    """Two-sided p of Student's t; NaN where t is missing or df is not positive."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    out = np.full(t.shape, np.nan)
    ok = ~np.isnan(t) & (df > 0)
    a, b, x = df[ok] / 2, np.full(ok.sum(), 0.5), df[ok] / (df[ok] + t[ok] ** 2)
    low = x < (a + 1) / (a + b + 2)
    share = np.where(low, _beta_share(a, b, np.where(low, x, 0.5)), 1 - _beta_share(b, a, np.where(low, 0.5, 1 - x)))
    out[ok] = np.where(x >= 1, 1.0, share)
    return out


def chi2_tail(x, df) -> np.ndarray:
    """Upper tail of chi-square, by the series of the lower incomplete gamma function (its terms are all positive)."""
    x, df = np.broadcast_arrays(np.asarray(x, float), np.asarray(df, float))
    out = np.full(x.shape, np.nan)
    ok = ~np.isnan(x) & (df > 0) & (x >= 0)
    a, z = df[ok] / 2, x[ok] / 2
    term, total = 1 / a, 1 / a
    for n in range(1, 2000):
        term = term * z / (a + n)
        total = total + term
        if not (term > 1e-16 * total).any():
            break
    with np.errstate(divide="ignore"):
        out[ok] = np.clip(1 - total * np.exp(a * np.log(z) - z - _LGAMMA(a)), 0, 1)
    return out


def t_pvalue(t: Column, df: Column) -> Column:
    """Two-sided p of t as a column; NULL where it is undefined."""
    tail = F.pandas_udf(lambda a, b: pd.Series(t_tail(a, b)), DoubleType())
    return F.nanvl(tail(t.cast("double"), df.cast("double")), F.lit(None))


def chi2_pvalue(x: Column, df: Column) -> Column:
    tail = F.pandas_udf(lambda a, b: pd.Series(chi2_tail(a, b)), DoubleType())
    return F.nanvl(tail(x.cast("double"), df.cast("double")), F.lit(None))
