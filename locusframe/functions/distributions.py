"""Distribution functions (X20). Closed forms are Columns; gamma and beta families are vectorised pandas functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def gamma_q(a: np.ndarray, x: np.ndarray, steps: int = 400) -> np.ndarray:
    """Upper regularised incomplete gamma: the series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    ok = (a > 0) & (x >= 0)
    low = ok & (x < a + 1)
    if low.any():
        p, q = a[low], x[low]
        term = total = 1 / p
        for n in range(1, steps):
            term = term * q / (p + n)
            total = total + term
        out[low] = 1 - np.where(q > 0, total * np.exp(-q + p * np.log(np.maximum(q, 1e-300)) - _lgamma(p)), 0)
    high = ok & (x >= a + 1)
    if high.any():
        p, q = a[high], x[high]
        b, c = q + 1 - p, np.full(p.shape, 1e300)
        d = 1 / b
        h = d
        for n in range(1, steps):
            k = -n * (n - p)
            b = b + 2
            d = 1 / np.where(np.abs(k * d + b) < 1e-300, 1e-300, k * d + b)
            c = np.where(np.abs(b + k / c) < 1e-300, 1e-300, b + k / c)
            h = h * d * c
        out[high] = np.exp(-q + p * np.log(q) - _lgamma(p)) * h
    return np.clip(out, 0, 1)


def beta_i(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 300) -> np.ndarray:
    """Regularised incomplete beta by a continued fraction, on the side where it converges fast."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(np.maximum(y, 1e-300)) + q * np.log1p(-np.minimum(y, 1 - 1e-16))) / p
        c, d = np.ones_like(y), 1 / np.where(np.abs(1 - (p + q) * y / (p + 1)) < 1e-300, 1e-300, 1 - (p + q) * y / (p + 1))
        h = d
        for m in range(1, steps):
            for k in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 / np.where(np.abs(1 + k * d) < 1e-300, 1e-300, 1 + k * d)
                c = np.where(np.abs(1 + k / c) < 1e-300, 1e-300, 1 + k / c)
                h = h * d * c
    value = np.where(y <= 0, 0.0, front * h)
    return np.clip(np.where(flip, 1 - value, value), 0, 1)


def f_tail(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """P(F > f) with d1 and d2 degrees of freedom."""
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(f, 0)))


def chi2_tail_udf():
    @F.pandas_udf("double")
    def tail(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(gamma_q(df.to_numpy(float) / 2, np.maximum(x.to_numpy(float), 0) / 2))

    return tail


def f_tail_udf():
    @F.pandas_udf("double")
    def tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        return pd.Series(f_tail(f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)))

    return tail


def log_gamma(x: np.ndarray) -> np.ndarray:
    return _lgamma(np.asarray(x, float))


def log_gamma_udf():
    @F.pandas_udf("double")
    def values(x: pd.Series) -> pd.Series:
        return pd.Series(log_gamma(x.to_numpy(float)))

    return values


def _quantile(tail, p: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 200) -> np.ndarray:
    """The x between low and high with P(X > x) = 1 - p, by bisection; null outside of 0 < p < 1."""
    for _ in range(steps):
        mid = (low + high) / 2
        above = tail(mid) > 1 - p
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return np.where((p > 0) & (p < 1), (low + high) / 2, np.nan)


def normal_quantile(p: np.ndarray) -> np.ndarray:
    p = np.asarray(p, float)
    return _quantile(lambda x: 0.5 * _erfc(x / math.sqrt(2)), p, np.full(p.shape, -40.0), np.full(p.shape, 40.0))


def gamma_quantile(p: np.ndarray, shape: float, scale: float = 1.0) -> np.ndarray:
    p = np.asarray(p, float)
    return scale * _quantile(lambda x: gamma_q(shape, x), p, np.zeros(p.shape), np.full(p.shape, shape + 40 * math.sqrt(shape) + 80))


def chi2_quantile(p: np.ndarray, df: float) -> np.ndarray:
    return gamma_quantile(p, df / 2, 2.0)


def moments(name: str, *parameters: float) -> tuple[float, float]:
    """Mean and variance: normal(mean, sd), gamma(shape, scale), chi2(df), exponential(rate), pareto(shape, scale)."""
    p = parameters
    if name == "pareto":
        k, x = p
        return (k * x / (k - 1) if k > 1 else math.inf, x * x * k / ((k - 1) ** 2 * (k - 2)) if k > 2 else math.inf)
    table = {"normal": lambda: (p[0], p[1] ** 2), "gamma": lambda: (p[0] * p[1], p[0] * p[1] ** 2), "chi2": lambda: (p[0], 2 * p[0]), "exponential": lambda: (1 / p[0], 1 / p[0] ** 2)}
    return table[name]()


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(-np.asarray(z, float) / math.sqrt(2))


def normal_pdf(x: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    z = (x - mean) / sd
    return F.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi))


def exponential_cdf(x: Column, rate: float) -> Column:
    return F.when(x <= 0, 0.0).otherwise(1 - F.exp(-rate * x))


def exponential_quantile(p: Column, rate: float) -> Column:
    return -F.log(1 - p) / rate


def pareto_cdf(x: Column, shape: float, scale: float) -> Column:
    return F.when(x < scale, 0.0).otherwise(1 - F.pow(scale / x, F.lit(shape)))


def pareto_quantile(p: Column, shape: float, scale: float) -> Column:
    return scale * F.pow(1 - p, F.lit(-1 / shape))


def chi2_tail_even(x: Column, df: int) -> Column:
    """P(chi-square > x) for an even df, in closed form."""
    if df % 2:
        raise ValueError("df is even here; use chi2_tail_udf")
    term, total = F.lit(1.0), F.lit(1.0)
    for k in range(1, df // 2):
        term = term * x / 2 / k
        total = total + term
    return F.exp(-x / 2) * total
