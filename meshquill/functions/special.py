"""Student's t and the incomplete beta function in plain Python, for a few values on the driver."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - betainc(b, a, 1.0 - x)
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 1000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * total / a


def t_two_sided_p(t: float, df: float) -> float:
    return betainc(df / 2.0, 0.5, df / (df + t * t))


@lru_cache(maxsize=10_000)
def t_quantile(p: float, df: int) -> float:
    """Inverse of Student's t distribution for p > 0.5: by bisection, from 200 degrees of freedom on by expansion."""
    if df > 200:
        z = NormalDist().inv_cdf(p)
        terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384)
        return z + sum(t / df ** (k + 1) for k, t in enumerate(terms))
    low, high = 0.0, 1.0
    while t_two_sided_p(high, df) > 2 * (1 - p):
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if t_two_sided_p(middle, df) > 2 * (1 - p) else (low, middle)
    return (low + high) / 2


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p-value of a Pearson or Spearman correlation."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1.0:
        return 0.0
    return t_two_sided_p(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)
