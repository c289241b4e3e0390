"""Tail probabilities on already reduced statistics (one number in, one number out)."""

from __future__ import annotations

import math


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of chi-square through the regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, z = df / 2.0, x / 2.0
    lead = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1.0 - total * lead)
    # Lentz continued fraction for the upper part.
    tiny = 1e-300
    b = z + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        step = d * c
        h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return lead * h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / ((1.0 - (a + b) * x / (a + 1)) or tiny)
    f = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / ((1.0 + even * d) or tiny)
        c = (1.0 + even / c) or tiny
        f *= c * d
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / ((1.0 + odd * d) or tiny)
        c = (1.0 + odd / c) or tiny
        step = c * d
        f *= step
        if abs(step - 1.0) < 1e-15:
            break
    return front * f


def student_t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def student_t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t for p >= 0.5, by bisection on the two-sided tail."""
    target = 2.0 * (1.0 - p)
    lo, hi = 0.0, 1.0
    while student_t_two_sided(hi, df) > target:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if student_t_two_sided(mid, df) > target else (lo, mid)
    return (lo + hi) / 2


def kolmogorov_sf(d: float, n: float, m: float) -> float:
    """Asymptotic two-sample Kolmogorov-Smirnov tail."""
    lam = d * math.sqrt(n * m / (n + m))
    if lam < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * lam) ** 2) for k in range(1, 101))))
