"""Tail probabilities in plain Python, for the few rows of test results."""

from __future__ import annotations

import math
from itertools import accumulate


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _gamma_upper(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b or tiny)
        c = b + k / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d or tiny)
            c = 1 + k / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return _gamma_upper(df / 2, x / 2)


def t_two_sided(t: float, df: float) -> float:
    return _beta(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def f_sf(f: float, d1: float, d2: float) -> float:
    return _beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def binomial_sf(k: int, n: int, p: float = 0.5) -> float:
    """Probability of k or more of n."""
    return 1.0 if k <= 0 else _beta(k, n - k + 1, p)


def signed_rank_sf(w: float, n: int) -> float:
    """Exact: probability that the positive ranks of 1..n sum to w or more."""
    counts = [1]
    for rank in range(1, n + 1):
        longer = counts + [0] * rank
        for i, c in enumerate(counts):
            longer[i + rank] += c
        counts = longer
    return sum(counts[math.ceil(w - 1e-9) :]) / 2**n if w > 0 else 1.0


def benjamini_hochberg(p: list[float]) -> list[float]:
    """Adjusted p-values in the order given."""
    order = sorted(range(len(p)), key=lambda i: -p[i])
    m = len(p)
    least = accumulate((p[i] * m / (m - k) for k, i in enumerate(order)), min)
    out = [0.0] * m
    for i, q in zip(order, least, strict=True):
        out[i] = min(1.0, q)
    return out
