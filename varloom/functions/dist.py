"""Distribution functions in numpy, without further libraries, and pandas UDFs of them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

_TINY = 1e-300


def norm_sf(z):
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(np.asarray(z, float) / math.sqrt(2))


def chi2_1_sf(x):
    return np.vectorize(math.erfc, otypes=[float])(np.sqrt(np.maximum(np.asarray(x, float), 0) / 2))


def norm_quantile(p: float) -> float:
    """Inverse of the normal distribution function, by bisection on erfc and Newton steps."""
    if p <= 0:
        return -math.inf
    if p >= 1:
        return math.inf
    if p > 0.5:
        return -norm_quantile(1 - p)
    lo, hi = -40.0, 0.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d, c = 1 / (d if abs(d) > _TINY else _TINY), c if abs(c) > _TINY else _TINY
            step = d * c
            h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h / a


def t_sf(t: float, df: float) -> float:
    """Upper tail of Student's t."""
    if math.isnan(t) or df <= 0:
        return math.nan
    half = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


def t_quantile_sf(p: float, df: float) -> float:
    """The t whose upper tail is p."""
    if df <= 0 or not 0 < p < 1:
        return math.nan
    if p > 0.5:
        return -t_quantile_sf(1 - p, df)
    lo, hi = 0.0, 1.0
    while t_sf(hi, df) > p and hi < 1e12:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_sf(mid, df) > p else (lo, mid)
    return (lo + hi) / 2


def gamma_sf(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    b, c = x + 1 - a, 1 / _TINY
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        c = b + an / c
        d, c = 1 / (d if abs(d) > _TINY else _TINY), c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2, x / 2)


def fisher_exact(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """Conditional maximum-likelihood odds ratio, and P of a or more, of the table [a b; c d]."""
    m, n, k = a + b, c + d, a + c
    lo, hi = max(0, k - n), min(k, m)
    x = np.arange(lo, hi + 1)
    lg = np.vectorize(math.lgamma, otypes=[float])
    logs = lg(m + 1.0) - lg(x + 1.0) - lg(m - x + 1.0) + lg(n + 1.0) - lg(k - x + 1.0) - lg(n - k + x + 1.0)
    p = np.exp(logs - logs.max())
    tail = float(p[x >= a].sum() / p.sum())
    if a == lo:
        return 0.0 if lo < hi else math.nan, tail
    if a == hi:
        return math.inf, tail

    def mean(log_odds):
        w = logs + x * log_odds
        w = np.exp(w - w.max())
        return float((x * w).sum() / w.sum())

    left, right = -50.0, 50.0
    for _ in range(200):
        mid = (left + right) / 2
        left, right = (mid, right) if mean(mid) < a else (left, mid)
    return math.exp((left + right) / 2), tail


@F.pandas_udf(DoubleType())
def t_tail_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_sf(x, d) if x is not None and not pd.isna(x) else math.nan for x, d in zip(t, df, strict=True)])


@F.pandas_udf(DoubleType())
def t_interval_udf(df: pd.Series, p: pd.Series) -> pd.Series:
    known: dict = {}
    return pd.Series([known.setdefault((d, q), t_quantile_sf(q, d)) if (d, q) not in known else known[d, q] for d, q in zip(df, p, strict=True)])


@F.pandas_udf(StructType([StructField("odds", DoubleType()), StructField("p", DoubleType())]))
def fisher_udf(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fisher_exact(*map(int, x)) for x in zip(a, b, c, d, strict=True)], columns=["odds", "p"])
