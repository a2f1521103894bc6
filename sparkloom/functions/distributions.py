"""Distribution functions: for numbers on the driver, and for columns, a whole Arrow block at a time (SQL has none of them).

The incomplete beta ratio is a continued fraction by the modified Lentz scheme, on whichever side of the mean converges.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.errors import UnableToConverge

_TINY, _EPS = 1e-300, 1e-16


def _told(p: float, lower: bool, log: bool, other: float | None = None) -> float:
    q = p if lower else (1 - p if other is None else other)
    return (math.log(q) if q > 0 else -math.inf) if log else q


def log_beta(a: float, b: float) -> float:
    small, large = sorted((a, b))
    if large > 500 and small < large / 100:  # lgamma(large) - lgamma(large + small) without cancelling
        x, y = large, large + small
        tail = (1 / x - 1 / y) / 12 - (1 / x**3 - 1 / y**3) / 360
        return math.lgamma(small) + (x - 0.5) * -math.log1p(small / x) - small * math.log(y) + small + tail
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def _fraction(x: float, a: float, b: float) -> float:
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > _TINY else _TINY)
    out = d
    for m in range(1, 100_000):
        before = out
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > _TINY else _TINY), c if abs(c) > _TINY else _TINY
            out *= d * c
        if abs(out - before) <= _EPS * 2 * abs(out):
            return out
    raise UnableToConverge("incomplete beta ratio")


def _ratio(x: float, a: float, b: float) -> tuple[float, float]:
    """I_x(a, b) and its complement, each without cancelling."""
    if x <= 0:
        return 0.0, 1.0
    if x >= 1:
        return 1.0, 0.0
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - log_beta(a, b))
    if x < (a + 1) / (a + b + 2):
        p = front * _fraction(x, a, b) / a
        return p, 1 - p
    q = front * _fraction(1 - x, b, a) / b
    return 1 - q, q


def beta_cdf(x: float, a: float, b: float, lower: bool = True, log: bool = False) -> float:
    if math.isnan(x) or math.isnan(a) or math.isnan(b) or a <= 0 or b <= 0:
        return math.nan
    p, q = _ratio(x, a, b)
    return _told(p, lower, log, q)


def f_cdf(f: float, d1: float, d2: float, lower: bool = True, log: bool = False) -> float:
    if math.isnan(f) or d1 <= 0 or d2 <= 0:
        return math.nan
    if f <= 0:
        return _told(0.0, lower, log)
    if math.isinf(f):
        return _told(1.0, lower, log)
    if d1 * f > d2:
        q, p = _ratio(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)
    else:
        p, q = _ratio(d1 * f / (d2 + d1 * f), d1 / 2, d2 / 2)
    return _told(p, lower, log, q)


def t_cdf(t: float, df: float, lower: bool = True, log: bool = False) -> float:
    if math.isnan(t) or df <= 0:
        return math.nan
    if math.isinf(t):
        return _told(float(t > 0), lower, log)
    tail = _ratio(df / (df + t * t), df / 2, 0.5)[0] / 2 if df < t * t else _ratio(t * t / (df + t * t), 0.5, df / 2)[1] / 2
    p, q = (1 - tail, tail) if t > 0 else (tail, 1 - tail)
    return _told(p, lower, log, q)


def t_pdf(t: float, df: float, log: bool = False) -> float:
    if math.isnan(t) or df <= 0:
        return math.nan
    if math.isinf(t):
        return -math.inf if log else 0.0
    out = -log_beta(df / 2, 0.5) - math.log(df) / 2 - (df + 1) / 2 * math.log1p(t * t / df)
    return out if log else math.exp(out)


def normal_cdf(x: float, mean: float = 0.0, sd: float = 1.0, lower: bool = True, log: bool = False) -> float:
    if math.isnan(x) or math.isnan(mean) or sd < 0:
        return math.nan
    if sd == 0:
        return _told(float(x >= mean), lower, log)
    z = (x - mean) / (sd * math.sqrt(2))
    p, q = math.erfc(-z) / 2, math.erfc(z) / 2
    if log and (p if lower else q) == 0:  # Mills' ratio where the tail is beyond doubles
        u = abs(z) * math.sqrt(2)
        return -u * u / 2 - math.log(u * math.sqrt(2 * math.pi)) + math.log1p(-1 / (u * u) + 3 / u**4)
    return _told(p, lower, log, q)


def normal_density(x: float, mean: float = 0.0, sd: float = 1.0, log: bool = False) -> float:
    if sd <= 0:
        return math.nan
    out = -(((x - mean) / sd) ** 2) / 2 - math.log(sd * math.sqrt(2 * math.pi))
    return out if log else math.exp(out)


def normal_quantile(p: float, mean: float = 0.0, sd: float = 1.0, lower: bool = True, log: bool = False) -> float:
    p = math.exp(p) if log else p
    if math.isnan(p) or not 0 <= p <= 1 or sd < 0:
        return math.nan
    p = p if lower else 1 - p
    if p in (0, 1):
        return math.inf if p else -math.inf
    return mean + sd * NormalDist().inv_cdf(p)


def t_quantile(p: float, df: float, lower: bool = True) -> float:
    """By bisection within doubling bounds, to the last bits."""
    if math.isnan(p) or not 0 <= p <= 1 or df <= 0:
        return math.nan
    p = p if lower else 1 - p
    if p in (0, 1):
        return math.inf if p else -math.inf
    if p < 0.5:
        return -t_quantile(1 - p, df)
    high = 1.0
    while t_cdf(high, df) < p and high < 1e300:
        high *= 2
    low = 0.0
    while (middle := (low + high) / 2) not in (low, high):
        low, high = (middle, high) if t_cdf(middle, df) < p else (low, middle)
    return middle


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: raised above 12, then Stirling's series."""
    x = np.asarray(x, float)
    low = np.where(x < 12, x, 12.0)
    up, shift = np.where(x < 12, 0.0, x), np.zeros_like(x)
    for i in range(12):
        shift += np.log(np.where(x < 12, low + i, 1.0))
    up = np.where(x < 12, x + 12, up)
    r = 1 / (up * up)
    tail = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r * (1 / 1188 - r * 691 / 360360))))) / up
    return (up - 0.5) * np.log(up) - up + math.log(2 * math.pi) / 2 + tail - shift


def _log_betas(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    small, large = np.minimum(a, b), np.maximum(a, b)
    far = (large > 500) & (small < large / 100)
    y = large + small
    tail = (1 / large - 1 / y) / 12 - (1 / large**3 - 1 / y**3) / 360
    return np.where(far, log_gamma(small) - (large - 0.5) * np.log1p(small / large) - small * np.log(y) + small + tail, log_gamma(small) + log_gamma(large) - log_gamma(y))


def _fractions(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """_fraction() of arrays; each is left alone once it has settled."""
    safe = lambda v: np.where(np.abs(v) > _TINY, v, _TINY)
    out, live = np.empty(len(x)), np.arange(len(x))
    c, d = np.ones(len(x)), 1 / safe(1 - (a + b) * x / (a + 1))
    f = d.copy()
    for m in range(1, 100_000):
        if not len(live):
            return out
        before = f
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / safe(1 + top * d), safe(1 + top / c)
            f = f * (d * c)
        done = np.abs(f - before) <= _EPS * 2 * np.abs(f)
        out[live[done]] = f[done]
        live, x, a, b, c, d, f = (v[~done] for v in (live, x, a, b, c, d, f))
    raise UnableToConverge("incomplete beta ratio")


def _ratios(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_ratio() of arrays."""
    inside = (x > 0) & (x < 1)
    x, a, b = np.where(inside, x, 0.5), np.where(inside, a, 1.0), np.where(inside, b, 1.0)
    below = x < (a + 1) / (a + b + 2)
    p, q, t = np.where(below, a, b), np.where(below, b, a), np.where(below, x, 1 - x)
    value = np.exp(a * np.log(x) + b * np.log1p(-x) - _log_betas(a, b)) * _fractions(t, p, q) / p
    return np.where(below, value, 1 - value), np.where(below, 1 - value, value)


def _side(p: np.ndarray, q: np.ndarray, lower: bool, log: bool) -> np.ndarray:
    out = p if lower else q
    with np.errstate(divide="ignore"):
        return np.log(out) if log else out


def beta_cdfs(x: np.ndarray, a: np.ndarray, b: np.ndarray, lower: bool = True, log: bool = False) -> np.ndarray:
    """beta_cdf() of arrays."""
    good = (a > 0) & (b > 0) & ~np.isnan(x)
    p, q = _ratios(np.where(good, x, 0.5), np.where(good, a, 1.0), np.where(good, b, 1.0))
    p, q = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, p)), np.where(x <= 0, 1.0, np.where(x >= 1, 0.0, q))
    return np.where(good, _side(p, q, lower, log), np.nan)


def f_cdfs(f: np.ndarray, d1: np.ndarray, d2: np.ndarray, lower: bool = True, log: bool = False) -> np.ndarray:
    """f_cdf() of arrays."""
    good = (d1 > 0) & (d2 > 0) & ~np.isnan(f)
    d1, d2, own = np.where(good, d1, 1.0), np.where(good, d2, 1.0), np.where(good & (f > 0) & np.isfinite(f), f, 1.0)
    far = d1 * own > d2
    p, q = _ratios(np.where(far, d2, d1 * own) / (d2 + d1 * own), np.where(far, d2, d1) / 2, np.where(far, d1, d2) / 2)
    p, q = np.where(far, q, p), np.where(far, p, q)
    p, q = np.where(f <= 0, 0.0, np.where(np.isposinf(f), 1.0, p)), np.where(f <= 0, 1.0, np.where(np.isposinf(f), 0.0, q))
    return np.where(good, _side(p, q, lower, log), np.nan)


def t_cdfs(t: np.ndarray, df: np.ndarray, lower: bool = True, log: bool = False) -> np.ndarray:
    """t_cdf() of arrays."""
    good = (df > 0) & ~np.isnan(t)
    df, own = np.where(good, df, 1.0), np.where(good & np.isfinite(t), t, 0.0)
    far, half = df < own * own, np.full(len(own), 0.5)
    p, q = _ratios(np.where(far, df, own * own) / (df + own * own), np.where(far, df / 2, half), np.where(far, half, df / 2))
    tail = np.where(own == 0, 0.5, np.where(far, p, q) / 2)
    tail = np.where(np.isinf(t), 0.0, tail)
    return np.where(good, _side(np.where(t > 0, 1 - tail, tail), np.where(t > 0, tail, 1 - tail), lower, log), np.nan)


def _erfc(z: np.ndarray) -> np.ndarray:
    """Of numbers from 0: the series of erf up to 2, a continued fraction beyond."""
    near, far = np.minimum(z, 2.0), np.maximum(z, 2.0)
    term, total = near.copy(), near.copy()
    for k in range(1, 60):
        term = term * 2 * near * near / (2 * k + 1)
        total = total + term
    below = 1 - 2 / math.sqrt(math.pi) * np.exp(-near * near) * total
    tail = np.zeros_like(far)
    for k in range(120, 0, -1):
        tail = k / 2 / (far + tail)
    return np.where(z <= 2, below, np.exp(-far * far) / math.sqrt(math.pi) / (far + tail))


def normal_cdfs(x: np.ndarray, mean: np.ndarray, sd: np.ndarray, lower: bool = True, log: bool = False) -> np.ndarray:
    """normal_cdf() of arrays."""
    good = (sd >= 0) & ~np.isnan(x) & ~np.isnan(mean)
    point = sd == 0
    z = np.where(good & ~point, (x - mean) / np.where(point, 1.0, sd), 0.0)
    tail = _erfc(np.minimum(np.abs(z), 60) / math.sqrt(2)) / 2
    p, q = np.where(z < 0, tail, 1 - tail), np.where(z < 0, 1 - tail, tail)
    p, q = np.where(point, (x >= mean).astype(float), p), np.where(point, (x < mean).astype(float), q)
    out = _side(p, q, lower, log)
    if log:  # Mills' ratio where the tail is beyond doubles
        u = np.maximum(np.abs(z), 1.0)
        out = np.where(np.isneginf(out) & ~point, -u * u / 2 - np.log(u * math.sqrt(2 * math.pi)) + np.log1p(-1 / (u * u) + 3 / u**4), out)
    return np.where(good, out, np.nan)


def normal_quantiles(p: np.ndarray, mean: np.ndarray, sd: np.ndarray, lower: bool = True, log: bool = False) -> np.ndarray:
    """normal_quantile() of arrays: a rough start (Abramowitz and Stegun 26.2.23), then steps of third order on the smaller tail."""
    p = np.exp(p) if log else p
    good = (p >= 0) & (p <= 1) & (sd >= 0)
    p = np.where(good, p, 0.5)
    small, sign = np.minimum(p, 1 - p), np.where((p < 0.5) == lower, -1.0, 1.0)
    inside = small > 0
    tail = np.where(inside, small, 0.25)
    r = np.sqrt(-2 * np.log(tail))
    z = r - (2.515517 + r * (0.802853 + r * 0.010328)) / (1 + r * (1.432788 + r * (0.189269 + r * 0.001308)))
    for _ in range(4):
        step = (_erfc(np.maximum(z, 0) / math.sqrt(2)) / 2 - tail) / (np.exp(-z * z / 2) / math.sqrt(2 * math.pi))
        z = z + step / (1 - z * step / 2)
    z = np.where(inside, z, np.inf)
    return np.where(good, mean + sd * sign * np.where(small == 0.5, 0.0, z), np.nan)


def _column(f: Callable[..., np.ndarray], *args: Column, **options: object) -> Column:
    @F.pandas_udf("double")
    def run(*series: pd.Series) -> pd.Series:
        cells = [s.to_numpy(float, na_value=np.nan) for s in series]
        out = pd.Series(f(*cells, **options))
        return out.where(~np.isnan(np.sum(cells, axis=0)) & out.notna(), None)

    return run(*args)


def beta_cdf_of(x: Column, a: Column, b: Column, **options: bool) -> Column:
    return _column(beta_cdfs, x, a, b, **options)


def f_cdf_of(f: Column, d1: Column, d2: Column, **options: bool) -> Column:
    return _column(f_cdfs, f, d1, d2, **options)


def t_cdf_of(t: Column, df: Column, **options: bool) -> Column:
    return _column(t_cdfs, t, df, **options)


def t_pdf_of(t: Column, df: Column, log: bool = False) -> Column:
    """Spark's own expressions but for the beta function's logarithm."""
    half = _column(_log_betas, df.cast("double") / 2, F.lit(0.5))
    out = -half - F.log(df) / 2 - (df + 1) / 2 * F.log1p(t * t / df)
    return F.when(F.isnan(t) | (df <= 0), None).otherwise(out if log else F.exp(out))


def normal_density_of(x: Column, mean: Column, sd: Column, log: bool = False) -> Column:
    """Spark's own expressions."""
    z = (x - mean) / sd
    out = -z * z / 2 - F.log(sd * math.sqrt(2 * math.pi))
    return F.when(sd > 0, out if log else F.exp(out))


def normal_cdf_of(x: Column, mean: Column, sd: Column, **options: bool) -> Column:
    return _column(normal_cdfs, x, mean, sd, **options)


def normal_quantile_of(p: Column, mean: Column, sd: Column, **options: bool) -> Column:
    return _column(normal_quantiles, p, mean, sd, **options)
