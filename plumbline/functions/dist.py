"""Distribution tails and quantiles.

Spark SQL has no incomplete beta or gamma, so these run as Arrow-batched pandas UDFs.  Operators call
them on result rows (one per group and test), never on data rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DOUBLE = T.DoubleType()
_TINY = 1e-300


def _elementwise(fn, x) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    return np.fromiter((fn(v) for v in x.ravel()), dtype=float, count=x.size).reshape(x.shape)


def _lgamma(x) -> np.ndarray:
    return _elementwise(math.lgamma, x)


def _erfc(x) -> np.ndarray:
    return _elementwise(math.erfc, x)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz), elementwise."""
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, 20000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = np.ones_like(h)
        for term in (even, odd):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = d * c
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-14):
            break
    return h


def betainc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & (b > 0) & np.isfinite(a) & np.isfinite(b) & np.isfinite(x)
    if not ok.any():
        return out
    a, b, xs = a[ok], b[ok], np.clip(x[ok], 0.0, 1.0)
    inner = np.clip(xs, _TINY, 1.0 - 1e-16)
    swap = inner > (a + 1.0) / (a + b + 2.0)
    p, q = np.where(swap, b, a), np.where(swap, a, b)
    y = np.where(swap, 1.0 - inner, inner)
    front = np.exp(
        p * np.log(np.maximum(y, _TINY)) + q * np.log1p(-y)
        + _lgamma(a + b) - _lgamma(a) - _lgamma(b)
    ) / p
    value = front * _beta_fraction(p, q, y)
    value = np.where(swap, 1.0 - value, value)
    out[ok] = np.where(xs <= 0, 0.0, np.where(xs >= 1, 1.0, value))
    return out


def gammaincc(s, x) -> np.ndarray:
    """Regularised upper incomplete gamma Q(s, x)."""
    s, x = np.broadcast_arrays(np.asarray(s, dtype=float), np.asarray(x, dtype=float))
    out = np.full(x.shape, np.nan)
    ok = (s > 0) & (x >= 0) & np.isfinite(s) & np.isfinite(x)
    if not ok.any():
        return out
    a, v = s[ok], x[ok]
    safe = np.maximum(v, _TINY)
    front = np.exp(a * np.log(safe) - v - _lgamma(a))
    series_side = v < a + 1.0
    # lower series
    term = 1.0 / a
    total = term.copy()
    for n in range(1, 100000):
        term = np.where(series_side, term * v / (a + n), 0.0)
        total = total + term
        if np.all(np.abs(term) <= np.abs(total) * 1e-16):
            break
    # upper continued fraction
    w = np.where(series_side, a + 2.0, v)
    b = w + 1.0 - a
    c = np.full_like(w, 1.0 / _TINY)
    d = 1.0 / np.where(np.abs(b) < _TINY, _TINY, b)
    h = d.copy()
    for n in range(1, 100000):
        an = -n * (n - a)
        b = b + 2.0
        d = an * d + b
        d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = b + an / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1.0) < 1e-14):
            break
    value = np.where(series_side, 1.0 - front * total, front * h)
    out[ok] = np.where(v <= 0, 1.0, np.clip(value, 0.0, 1.0))
    return out


def norm_sf(z) -> np.ndarray:
    return 0.5 * _erfc(np.asarray(z, dtype=float) / math.sqrt(2.0))


def t_two_sided(t, df) -> np.ndarray:
    t, df = np.broadcast_arrays(np.asarray(t, dtype=float), np.asarray(df, dtype=float))
    with np.errstate(all="ignore"):
        value = betainc(df / 2.0, 0.5, df / (df + t * t))
    return np.where(np.isinf(t) & (df > 0), 0.0, value)


def t_upper(t, df) -> np.ndarray:
    half = t_two_sided(t, df) / 2.0
    return np.where(np.asarray(t, dtype=float) >= 0, half, 1.0 - half)


def f_upper(f, d1, d2) -> np.ndarray:
    f, d1, d2 = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (f, d1, d2)))
    with np.errstate(all="ignore"):
        value = betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))
    return np.where(np.isinf(f) & (f > 0), 0.0, np.where(f < 0, 1.0, value))


def chi2_upper(x, df) -> np.ndarray:
    return gammaincc(np.asarray(df, dtype=float) / 2.0, np.asarray(x, dtype=float) / 2.0)


def binom_upper(k, n, p) -> np.ndarray:
    """P(X >= k) for X ~ Binomial(n, p)."""
    k, n, p = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (k, n, p)))
    return np.where(k <= 0, 1.0, np.where(k > n, 0.0, betainc(np.maximum(k, 0.5), n - k + 1, p)))


def poisson_upper(k, mu) -> np.ndarray:
    """P(X >= k) for X ~ Poisson(mu)."""
    k, mu = np.broadcast_arrays(np.asarray(k, dtype=float), np.asarray(mu, dtype=float))
    return np.where(k <= 0, 1.0, 1.0 - gammaincc(np.maximum(k, 0.5), mu))


def _bisect(tail, target: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Solve tail(x) = target for a decreasing tail."""
    for _ in range(200):
        mid = (low + high) / 2.0
        above = tail(mid) > target
        low, high = np.where(above, mid, low), np.where(above, high, mid)
        if np.all(high - low <= 1e-13 * np.maximum(1.0, np.abs(high))):
            break
    return (low + high) / 2.0


def norm_quantile(q) -> np.ndarray:
    q = np.asarray(q, dtype=float)
    bound = np.full(q.shape, 40.0)
    out = _bisect(norm_sf, 1.0 - q, -bound, bound)
    return np.where((q > 0) & (q < 1), out, np.nan)


def t_quantile(q, df) -> np.ndarray:
    """Quantile of Student's t, for q above one half solved on the upper tail."""
    q, df = np.broadcast_arrays(np.asarray(q, dtype=float), np.asarray(df, dtype=float))
    upper = np.minimum(q, 1.0 - q)
    ok = (upper > 0) & (df > 0)
    dfs = np.where(ok, df, 1.0)
    goal = np.where(ok, upper, 0.25)
    high = np.full(q.shape, 1.0)
    for _ in range(600):
        short = t_upper(high, dfs) > goal
        if not short.any():
            break
        high = np.where(short, high * 2.0, high)
    root = _bisect(lambda x: t_upper(x, dfs), goal, np.zeros(q.shape), high)
    return np.where(ok, np.where(q >= 0.5, root, -root), np.nan)


def _series_udf(fn):
    def run(*columns: pd.Series) -> pd.Series:
        arrays = [c.to_numpy(dtype=float, na_value=np.nan) for c in columns]
        return pd.Series(fn(*arrays)).replace({np.nan: None}).astype("float64")
    return run


@F.pandas_udf(_DOUBLE)
def _t2(t: pd.Series, df: pd.Series) -> pd.Series:
    return _series_udf(t_two_sided)(t, df)


@F.pandas_udf(_DOUBLE)
def _t1(t: pd.Series, df: pd.Series) -> pd.Series:
    return _series_udf(t_upper)(t, df)


@F.pandas_udf(_DOUBLE)
def _f(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _series_udf(f_upper)(f, d1, d2)


@F.pandas_udf(_DOUBLE)
def _chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return _series_udf(chi2_upper)(x, df)


@F.pandas_udf(_DOUBLE)
def _norm(z: pd.Series) -> pd.Series:
    return _series_udf(norm_sf)(z)


@F.pandas_udf(_DOUBLE)
def _binom(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return _series_udf(binom_upper)(k, n, p)


@F.pandas_udf(_DOUBLE)
def _poisson(k: pd.Series, mu: pd.Series) -> pd.Series:
    return _series_udf(poisson_upper)(k, mu)


@F.pandas_udf(_DOUBLE)
def _tq(q: pd.Series, df: pd.Series) -> pd.Series:
    return _series_udf(t_quantile)(q, df)


@F.pandas_udf(_DOUBLE)
def _nq(q: pd.Series) -> pd.Series:
    return _series_udf(norm_quantile)(q)


def _col(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("double")


def p_t(t, df) -> Column:
    """Two-sided p of a t statistic."""
    return _t2(_col(t), _col(df))


def p_t_upper(t, df) -> Column:
    return _t1(_col(t), _col(df))


def p_f(f, d1, d2) -> Column:
    return _f(_col(f), _col(d1), _col(d2))


def p_chi2(x, df) -> Column:
    return _chi2(_col(x), _col(df))


def p_norm(z) -> Column:
    """Two-sided p of a z statistic."""
    return F.least(F.lit(1.0), _norm(F.abs(_col(z))) * 2.0)


def p_norm_upper(z) -> Column:
    return _norm(_col(z))


def p_binom(k, n, p) -> Column:
    return _binom(_col(k), _col(n), _col(p))


def p_poisson(k, mu) -> Column:
    return _poisson(_col(k), _col(mu))


def q_t(q, df) -> Column:
    return _tq(_col(q), _col(df))


def q_norm(q) -> Column:
    return _nq(_col(q))


def norm_quantile_expr(p: Column) -> Column:
    """Normal quantile as plain Column math (rational approximation, relative error below 1.2e-9).

    For the places that need a quantile on every data row, where a Python UDF would be too slow.
    """
    # fixed values: coefficients of the published rational approximation
    a = (-39.69683028665376, 220.9460984245205, -275.9285104469687,
         138.3577518672690, -30.66479806614716, 2.506628277459239)
    b = (-54.47609879822406, 161.5858368580409, -155.6989798598866,
         66.80131188771972, -13.28068155288572, 1.0)
    c = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838,
         -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)

    def poly(coefficients, x: Column) -> Column:
        out = F.lit(coefficients[0])
        for k in coefficients[1:]:
            out = out * x + F.lit(k)
        return out

    low = 0.02425
    q = p - 0.5
    r = q * q
    centre = poly(a, r) * q / poly(b, r)
    side = F.sqrt(F.lit(-2.0) * F.log(F.least(p, 1.0 - p)))
    outer = poly(c, side) / poly(d, side)
    return (
        F.when((p > low) & (p < 1.0 - low), centre)
        .when(p < 0.5, outer)
        .otherwise(-outer)
    )
