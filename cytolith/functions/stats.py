"""Numeric kernels on numpy arrays (no scipy here)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def log_sum_exp(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    """log of the sum of exponentials; -inf for an empty or all -inf axis."""
    x = np.asarray(x, float)
    top = np.max(x, axis=axis, keepdims=True, initial=-np.inf)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        out = np.log(np.sum(np.exp(x - safe), axis=axis, keepdims=True)) + safe
    return np.squeeze(out, axis=axis) if axis is not None else float(out.reshape(-1)[0])


def gauss_log_density(x: np.ndarray, mu: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    z = (np.asarray(x, float)[:, None] - mu) / sigma
    return -0.5 * z * z - np.log(sigma) - 0.5 * math.log(2 * math.pi)


def student_log_density(x: np.ndarray, mu: np.ndarray, sigma: np.ndarray, nu: np.ndarray) -> np.ndarray:
    nu = np.asarray(nu, float)
    z = (np.asarray(x, float)[:, None] - mu) / sigma
    return _lgamma(nu / 2 + 0.5) - _lgamma(nu / 2) - np.log(sigma) - 0.5 * np.log(nu * math.pi) - (nu + 1) / 2 * np.log1p(z * z / nu)


def minimise(f: Callable[[float], float], low: float, high: float, tolerance: float = 1e-5) -> float:
    """Golden-section search of a function with one valley."""
    ratio = (math.sqrt(5) - 1) / 2
    a, b = low, high
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tolerance:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = f(d)
    return (a + b) / 2


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for k in range(400):
        m = k // 2
        top = 1.0 if k == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or tiny)
        c = 1 + top / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of a t statistic."""
    if not math.isfinite(t):
        return 0.0 if math.isinf(t) else float("nan")
    if math.isinf(df) or df > 1e10:
        return math.erfc(abs(t) / math.sqrt(2))
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    inv = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv * (1 / 240 - inv / 132))))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out += 1 / (x * x)
        x += 1
    inv = 1 / (x * x)
    return out + 1 / x + inv / 2 + inv / x * (1 / 6 - inv * (1 / 30 - inv * (1 / 42 - inv / 30)))


def trigamma_inverse(y: float) -> float:
    """x with trigamma(x) = y, by bisection on a log scale."""
    low, high = 1e-8, 1e8
    for _ in range(200):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if trigamma(mid) > y else (low, mid)
    return math.sqrt(low * high)


def moderated_t_of(difference: np.ndarray, s2: np.ndarray, n1: int, n2: int) -> np.ndarray:
    """p-values of two-group comparisons from each row's difference of means and pooled variance, variances shrunk over rows."""
    df = n1 + n2 - 2
    if n1 < 1 or n2 < 1 or df < 1:
        return np.full(len(s2), np.nan)
    positive = s2[s2 > 0]
    d0, s0 = math.inf, float(np.mean(s2)) if len(s2) else 1.0
    if len(positive) > 1:
        e = np.log(positive) - digamma(df / 2) + math.log(df / 2)
        spread = e.var(ddof=1) - trigamma(df / 2)
        if spread > 0:
            d0 = 2 * trigamma_inverse(spread)
            s0 = math.exp(e.mean() + digamma(d0 / 2) - math.log(d0 / 2))
        else:
            s0 = math.exp(e.mean())
    post = (np.full_like(s2, s0) if math.isinf(d0) else (d0 * s0 + df * s2) / (d0 + df))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = difference / np.sqrt(post * (1 / n1 + 1 / n2))
    total = min(df + d0, df * len(s2))
    return np.array([t_two_sided(x, total) for x in t])


def benjamini_hochberg(p: np.ndarray) -> np.ndarray:
    """Adjusted p-values; NaN stays NaN and isn't counted."""
    out = np.full(len(p), np.nan)
    known = np.flatnonzero(~np.isnan(p))
    order = known[np.argsort(-p[known], kind="stable")]
    n = len(order)
    out[order] = np.minimum(1, np.minimum.accumulate(p[order] * n / np.arange(n, 0, -1)))
    return out


def ideal_fourths(x: np.ndarray) -> tuple[float, float]:
    """Machine quartiles."""
    x = np.sort(x)
    n = len(x)
    j = math.floor(n / 4 + 5 / 12)
    g = n / 4 - j + 5 / 12
    pick = lambda k: x[min(max(k, 1), n) - 1]
    k = n - j + 1
    return (1 - g) * pick(j) + g * pick(j + 1), (1 - g) * pick(k) + g * pick(k - 1)


def boxplot_fences(x: np.ndarray) -> tuple[float, float]:
    low, high = ideal_fourths(x)
    return low - 1.5 * (high - low), high + 1.5 * (high - low)


def dirichlet(rng: np.random.Generator, alpha: np.ndarray) -> np.ndarray:
    """One draw: gamma variates brought to the sum of 1."""
    x = rng.gamma(np.asarray(alpha, float))
    return x / x.sum()


def leaf_order(x: np.ndarray) -> list[int]:
    """Rows in the order of a clustering tree: complete linkage of Euclidean distances; of two branches that with the smaller sum of row means comes first."""
    x = np.asarray(x, float)
    n = len(x)
    if n < 2:
        return list(range(n))
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(2), 0))
    np.fill_diagonal(d, np.inf)
    means = np.nanmean(x, axis=1)
    branches = {k: ([k], float(means[k])) for k in range(n)}
    while len(branches) > 1:
        i, j = divmod(int(d.argmin()), n)
        (a, u), (b, v) = branches.pop(i), branches.pop(j)
        branches[i] = ([*a, *b] if u <= v else [*b, *a], u + v)
        d[i] = d[:, i] = np.maximum(d[i], d[j])
        d[j] = d[:, j] = np.inf
        d[i, i] = np.inf
    return next(iter(branches.values()))[0]


def weighted_quantile(x: np.ndarray, weight: np.ndarray, q: float) -> float:
    """The quantile (linear between neighbours) of sorted values that each stand for so many."""
    ends = np.cumsum(weight)
    at = q * (ends[-1] - 1)
    low, high = (x[np.searchsorted(ends, k, "right")] for k in (math.floor(at), math.ceil(at)))
    return float(low + (high - low) * (at - math.floor(at)))


def weighted_deviation(x: np.ndarray, weight: np.ndarray) -> float:
    """Sample deviation of values that each stand for so many."""
    n = weight.sum()
    mean = (x * weight).sum() / n
    return float(math.sqrt((weight * (x - mean) ** 2).sum() / (n - 1))) if n > 1 else 0.0
