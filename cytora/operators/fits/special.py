"""Distribution functions that tests need, without further libraries."""

from __future__ import annotations

import math

import numpy as np


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.array([math.erfc(-v / math.sqrt(2)) for v in np.atleast_1d(z)])


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def ks_sf(d: float, n1: int, n2: int) -> float:
    """Asymptotic two-sided probability of a two-sample distance."""
    t = d * math.sqrt(n1 * n2 / (n1 + n2))
    if t < 1e-3:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))


def mann_whitney_p(u: float, n1: int, n2: int, ties: float = 0.0) -> float:
    """Two-sided normal approximation with continuity correction; ``ties`` is the sum of t^3 - t."""
    n = n1 + n2
    sd = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) if n > 1 else 0.0
    if sd == 0:
        return 1.0
    return min(1.0, 2 * normal_sf((abs(u - n1 * n2 / 2) - 0.5) / sd))


def normality_p(n: int, skew: float, kurtosis: float) -> float:
    """Omnibus probability from skewness and kurtosis (third and fourth standardised moments); NaN below 8 values."""
    if n < 8:
        return math.nan
    y = skew * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (beta2 - 1)) - 1
    alpha = math.sqrt(2 / (w2 - 1))
    z1 = math.asinh(y / alpha) / math.sqrt(math.log(math.sqrt(w2)))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (kurtosis - mean) / math.sqrt(var)
    b1 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b1 * (2 / b1 + math.sqrt(1 + 4 / b1**2))
    t = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - math.copysign(abs(t) ** (1 / 3), t)) / math.sqrt(2 / (9 * a))
    return chi2_sf(z1 * z1 + z2 * z2, 2)
