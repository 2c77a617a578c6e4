"""Tail probabilities and quantiles for small result tables, as Arrow functions."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _lgamma(x) -> np.ndarray:
    return np.asarray(np.frompyfunc(math.lgamma, 1, 1)(x), dtype=float)


def _erfc(x) -> np.ndarray:
    return np.asarray(np.frompyfunc(math.erfc, 1, 1)(x), dtype=float)


def _stirling(z):
    """What the logarithm of the gamma function has beyond its leading terms, for large ``z``."""
    return 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5)


def log_beta(a, b):
    """Logarithm of the beta function, without the difference of two large numbers."""
    small, large = np.minimum(a, b), np.maximum(a, b)
    big = large > 100
    safe = np.where(big, large, 200.0)
    far = (_lgamma(small) + _stirling(safe) - _stirling(safe + small) + small - small * np.log(safe)
           - (safe + small - 0.5) * np.log1p(small / safe))
    return np.where(big, far, _lgamma(small) + _lgamma(large) - _lgamma(small + large))


def beta_tail(x, a, b, rest=None):
    """Regularised incomplete beta function, by its continued fraction; ``rest`` is ``1 - x`` where that has more digits."""
    rest = 1 - np.asarray(x, float) if rest is None else rest
    x, a, b, rest = np.broadcast_arrays(*[np.asarray(v, float) for v in (x, a, b, rest)])
    flip = x > (a + 1) / (a + b + 2)
    x, rest, a, b = np.where(flip, rest, x), np.where(flip, x, rest), np.where(flip, b, a), np.where(flip, a, b)
    tiny = 1e-300
    with np.errstate(all="ignore"):
        front = np.exp(-log_beta(a, b) + a * np.where(rest < 0.5, np.log1p(-rest), np.log(x))
                       + b * np.where(x < 0.5, np.log1p(-x), np.log(rest))) / a
        c = np.ones_like(x)
        d = 1 - (a + b) * x / (a + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        value = d.copy()
        for m in range(1, 100_000):
            for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                         -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + term * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + term / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                step = c * d
                value = value * step
            if np.all((np.abs(step - 1) < 1e-15) | ~np.isfinite(step) | (x <= 0) | (x >= 1)):
                break
        else:
            raise ArithmeticError("the continued fraction of the beta function has not converged")
        out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, front * value))
    return np.where(flip, 1 - out, out)


def gamma_tail(a, x):
    """Regularised upper incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) - x - _lgamma(a))
        term = 1 / a
        total = term.copy()
        for n in range(1, 1_000_000):
            term = term * x / (a + n)
            total = total + term
            if np.all((np.abs(term) <= np.abs(total) * 1e-17) | (x >= a + 1)):
                break
        else:
            raise ArithmeticError("the series of the gamma function has not converged")
        lower = front * total
        b = x + 1 - a
        c = np.full_like(x, 1e300)
        d = 1 / b
        h = d.copy()
        for i in range(1, 1_000_000):
            an = -i * (i - a)
            b = b + 2
            d = 1 / (an * d + b)
            c = b + an / c
            h = h * d * c
            if np.all((np.abs(d * c - 1) < 1e-15) | (x < a + 1) | ~np.isfinite(h)):
                break
        else:
            raise ArithmeticError("the continued fraction of the gamma function has not converged")
        upper = np.where(x < a + 1, 1 - lower, front * h)
    return np.where(x <= 0, 1.0, upper)


def t_two_sided(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    # With very many degrees of freedom the fraction loses digits; a normal value corrected to order 1/df has them.
    near = np.minimum(df, 1e6)
    z = np.sqrt(df * np.log1p(t * t / df)) * (8 * df + 1) / (8 * df + 3)
    return np.where(df > 1e6, _erfc(z / math.sqrt(2)), beta_tail(near / (near + t * t), near / 2, 0.5, t * t / (near + t * t)))


def t_quantile(level, df):
    """Two-sided critical value of Student's t at ``level`` by bisection."""
    level, df = np.broadcast_arrays(np.asarray(level, float), np.asarray(df, float))
    low, high = np.zeros(df.shape), np.ones(df.shape)
    while np.any(short := t_two_sided(high, df) > 1 - level):
        high = np.where(short, 2 * high, high)
        if np.any(high > 1e300):
            raise ArithmeticError("no finite quantile")
    while True:
        mid = (low + high) / 2
        if np.all((mid == low) | (mid == high)):
            return mid
        wide = t_two_sided(mid, df) > 1 - level
        low, high = np.where(wide, mid, low), np.where(wide, high, mid)


def _series(values: np.ndarray, *inputs: pd.Series) -> pd.Series:
    known = np.logical_and.reduce([i.notna().to_numpy() for i in inputs])
    return pd.Series(np.where(known, values, np.nan)).astype("Float64").mask(~known)


def t_p_value(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def run(t: pd.Series, df: pd.Series) -> pd.Series:
        return _series(t_two_sided(t.fillna(0), df.fillna(1).clip(lower=1)), t, df)

    return run(t.cast("double"), df.cast("double"))


def normal_p_value(z: Column) -> Column:
    @F.pandas_udf("double")
    def run(z: pd.Series) -> pd.Series:
        return _series(_erfc(np.abs(z.fillna(0).to_numpy()) / math.sqrt(2)) if len(z) else np.empty(0), z)

    return run(z.cast("double"))


def f_p_value(f: Column, df1: Column, df2: Column) -> Column:
    @F.pandas_udf("double")
    def run(f: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        f0, a0, b0 = f.fillna(0), a.fillna(1), b.fillna(1)
        return _series(beta_tail(b0 / (b0 + a0 * f0), b0 / 2, a0 / 2), f, a, b)

    return run(f.cast("double"), df1.cast("double"), df2.cast("double"))


def chi2_p_value(x: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, df: pd.Series) -> pd.Series:
        return _series(gamma_tail(df.fillna(1) / 2, x.fillna(0) / 2), x, df)

    return run(x.cast("double"), df.cast("double"))


def t_critical(level: float, df: Column) -> Column:
    @F.pandas_udf("double")
    def run(df: pd.Series) -> pd.Series:
        # Few distinct degrees of freedom: solve each once.
        distinct = df.dropna().unique()
        return df.map(dict(zip(distinct, t_quantile(level, distinct)))).astype("Float64")

    return run(df.cast("double"))


def normal_critical(level: float) -> float:
    return NormalDist().inv_cdf(0.5 + level / 2)


def critical_value(level: float, n: Column) -> Column:
    """Normal from 100 rows on, Student's t with ``n - 2`` degrees of freedom below."""
    return F.when(n >= 100, F.lit(normal_critical(level))).otherwise(
        t_critical(level, F.greatest(F.lit(1), n - 2)))


# Kiefer-Vogelsang (2005) cubic for the Bartlett kernel, by size of the test.
FIXED_B_BARTLETT = {
    0.10: (1.6449, 2.1859, 0.3142, -0.3427),
    0.05: (1.9600, 2.9694, 0.4160, -0.5324),
    0.01: (2.3263, 4.1618, 0.5368, -0.9060),
}


def fixed_b_bartlett(level: float, b: Column) -> Column | None:
    """Critical value for the bandwidth share ``b``; none for other sizes of the test."""
    sizes = [a for a in FIXED_B_BARTLETT if abs(a - (1 - level)) <= 1e-3]
    if not sizes:
        return None
    c0, c1, c2, c3 = FIXED_B_BARTLETT[sizes[0]]
    x = F.least(F.greatest(b, F.lit(0.0)), F.lit(1.0))
    return F.when(b > 0, c0 + c1 * x + c2 * x * x + c3 * x * x * x)
