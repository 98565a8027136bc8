"""Statistics as column expressions, and special functions for Arrow batches (no SciPy)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def chisq_2x2(a, b, c, d, pseudo=0.0) -> Column:
    """Chi-square of a 2x2 table with ``pseudo`` added to each cell; 0 where a margin is 0."""
    pseudo = _c(pseudo) if isinstance(pseudo, (str, Column)) else F.lit(float(pseudo))
    a, b, c, d = (_c(v).cast("double") + pseudo for v in (a, b, c, d))
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(margins > 0, (a * d - b * c) * (a * d - b * c) * (a + b + c + d) / margins).otherwise(F.lit(0.0))


def odds_ratio(a, b, c, d, pseudo: float = 0.0) -> Column:
    a, b, c, d = (_c(v).cast("double") + F.lit(float(pseudo)) for v in (a, b, c, d))
    return F.try_divide(a * d, b * c)


def logit(p) -> Column:
    return F.log(_c(p) / (1 - _c(p)))


def clamp(x, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(x)))


def safe_log10(x, floor: float = 1e-300) -> Column:
    return F.log10(F.greatest(_c(x), F.lit(floor)))


def cauchy(ps) -> Column:
    """Cauchy combination of an array of p-values with equal weights."""
    t = F.aggregate(_c(ps), F.lit(0.0), lambda a, p: a + F.cot(F.lit(math.pi) * p)) / F.size(_c(ps))
    return F.lit(0.5) - F.atan(t) / F.lit(math.pi)


def log10p_of(chisq: np.ndarray) -> np.ndarray:
    """-log10 of the upper tail of chi-square with one degree of freedom, far tails by their asymptote."""
    z = np.sqrt(np.maximum(np.asarray(chisq, float), 0) / 2)
    near = np.minimum(z, 10)
    exact = -np.log10(np.array([math.erfc(v) if v == v else math.nan for v in near]))
    far = (z * z + np.log(np.maximum(z, 1) * math.sqrt(math.pi))) / math.log(10)
    return np.where(z < 10, exact, far)


@F.pandas_udf(T.DoubleType())
def log10p(chisq: pd.Series) -> pd.Series:
    return pd.Series(log10p_of(chisq.to_numpy(float, na_value=np.nan)), index=chisq.index)


@F.pandas_udf(T.DoubleType())
def two_sided(z: pd.Series) -> pd.Series:
    """Two-sided p-value of a normal score."""
    return pd.Series([math.erfc(abs(v) / math.sqrt(2)) if v == v else math.nan for v in z.to_numpy(float, na_value=np.nan)], index=z.index)


def digamma(x: np.ndarray) -> np.ndarray:
    """Digamma of positive numbers: recurrence up to 6, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        if not low.any():
            break
        out = np.where(low, out - 1 / np.where(low, x, 1.0), out)
        x = np.where(low, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def lgamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def loess(x: np.ndarray, y: np.ndarray, span: float = 0.3) -> np.ndarray:
    """Local quadratic fit with tricube weights at each x."""
    n = len(x)
    k = min(n, max(3, int(math.ceil(span * n))))
    order = np.argsort(x, kind="stable")
    xs, ys, out = x[order], y[order], np.zeros(n)
    lo = 0
    for i in range(n):
        while lo + k < n and xs[lo + k] - xs[i] < xs[i] - xs[lo]:
            lo += 1
        dx = xs[lo : lo + k] - xs[i]
        h = max(np.abs(dx).max(), 1e-12)
        w = np.sqrt((1 - np.minimum(1, np.abs(dx) / h) ** 3) ** 3)
        a = np.stack([np.ones(k), dx, dx * dx], 1) * w[:, None]
        out[i] = np.linalg.lstsq(a, ys[lo : lo + k] * w, rcond=None)[0][0]
    back = np.empty(n)
    back[order] = out
    return back


def nonnegative_ridge(a: np.ndarray, b: np.ndarray, penalty: float = 1e-6, rounds: int = 2000) -> np.ndarray:
    """argmin over x >= 0 of |a x - b|^2 + penalty |x|^2, by coordinate descent; b may have several columns."""
    g = a.T @ a + penalty * np.eye(a.shape[1])
    h = a.T @ b
    x = np.maximum(0, np.linalg.solve(g, h))
    for _ in range(rounds):
        before = x.copy()
        for j in range(len(g)):
            x[j] = np.maximum(0, x[j] + (h[j] - g[j] @ x) / g[j, j])
        if np.abs(x - before).max() < 1e-12:
            break
    return x


def bhattacharyya(p, q) -> Column:
    """Coefficient of two arrays of shares, between 0 and 1; entries at or below 0 count nothing."""
    root = lambda a, b: F.when((a > 0) & (b > 0), F.sqrt(a * b)).otherwise(F.lit(0.0))
    return clamp(F.aggregate(F.zip_with(_c(p), _c(q), root), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))), 0.0, 1.0)


def to_simplex(v: np.ndarray) -> np.ndarray:
    """The nearest point of the simplex (entries of at least 0 that sum to 1) to each row."""
    v = np.atleast_2d(np.asarray(v, float))
    u = -np.sort(-v, axis=1)
    t = (np.cumsum(u, 1) - 1) / np.arange(1, v.shape[1] + 1)
    last = v.shape[1] - 1 - np.argmax((u > t)[:, ::-1], axis=1)
    return np.maximum(0, v - t[np.arange(len(v)), last][:, None])


def local_edits(pattern: str, text: str) -> tuple[int, int]:
    """Fewest edits that turn ``pattern`` into some piece of ``text``, and where the first such piece ends."""
    row = np.arange(len(pattern) + 1)
    best, end = len(pattern), 0
    for j, c in enumerate(text, 1):
        new = np.empty_like(row)
        new[0] = 0
        for i, x in enumerate(pattern, 1):
            new[i] = min(row[i - 1] + (x != c), row[i] + 1, new[i - 1] + 1)
        row = new
        if row[-1] < best:
            best, end = int(row[-1]), j
    return best, end
