"""Component curves as columns, and what fits to histograms share."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- curves ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Curve:
    """A component or a weighted sum of curves: kind, parameters, and for sums the parts' names and weights."""

    kind: str
    parameters: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, ...] = ()
    parts: tuple[tuple[str, float], ...] = ()


def log_choose(n: int, k: int) -> float:
    """Logarithm of the number of ways to choose k of n."""
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) if 0 <= k <= n else -math.inf


def hypergeometric(population: int, successes: int, draws: int) -> list[float]:
    """Chance of 0, 1, ... ``successes`` among the drawn, NaN where the numbers don't allow it; none for impossible parameters."""
    if population <= 0 or not 0 <= successes <= population or not 0 <= draws <= population:
        return []
    possible = lambda k: k <= draws and draws - k <= population - successes
    return [math.exp(log_choose(successes, k) + log_choose(population - successes, draws - k) - log_choose(population, draws)) if possible(k) else math.nan for k in range(successes + 1)]


def curve_column(name: str, curves: dict[str, Curve], x: Column, seen: tuple[str, ...] = ()) -> Column:
    """Value of a curve at ``x``; a sum that contains itself is NaN."""
    if name in seen or name not in curves:
        return F.lit(float("nan"))
    c, p = curves[name], curves[name].parameters
    if c.kind == "normal":
        z = (x - p["mean"]) / max(p["sigma"], 1e-12)
        return p["amplitude"] * F.exp(-0.5 * z * z)
    if c.kind == "linear":
        return p["slope"] * x + p["intercept"]
    if c.kind == "exponential":
        return p["offset"] + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), p["rate"] * x + p["intercept"])))
    if c.kind == "gamma":
        k, theta = p["shape"], p["scale"]
        log = (k - 1) * F.ln(x / theta) - x / theta - math.lgamma(k) - math.log(theta)
        return F.when(x > 0, p["amplitude"] * F.exp(log)).otherwise(0.0)
    nan = F.lit(float("nan"))
    if c.kind == "gamma_density":
        k, theta = p["shape"], p["scale"]
        if k <= 0 or theta <= 0:
            return nan
        at_zero = 1 / theta if k == 1 else math.inf if k < 1 else 0.0
        log = (k - 1) * F.ln(x) - x / theta - math.lgamma(k) - k * math.log(theta)
        return F.when(x > 0, F.exp(log)).when(x == 0, at_zero).otherwise(nan)
    if c.kind == "log_logistic":
        k, top, middle = p["slope"], p["upper"], p["midpoint"]
        if min(k, top, middle) <= 0:
            return nan
        bent = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), k * (F.ln(x) - math.log(middle))))
        return F.when(x > 0, top / (1 + F.exp(bent))).otherwise(nan)
    if c.kind == "hypergeometric":
        chances = hypergeometric(int(p["population"]), int(p["successes"]), int(p["draws"]))
        near = F.round(x)
        return F.when(F.abs(x - near) <= 1e-6, F.coalesce(F.get(F.array(*[F.lit(v) for v in chances]), near.cast("int")), nan)).otherwise(nan) if chances else nan
    if c.kind == "polynomial":
        lo, hi = p["minimum"], p["maximum"]
        t = (x - lo) / (hi - lo)
        value = F.lit(0.0)
        for a in reversed(c.coefficients):
            value = value * t + a
        return F.when((x >= lo) & (x <= hi), F.greatest(value, F.lit(0.0))).otherwise(0.0)
    if c.kind == "addition":
        total = F.lit(p.get("intercept", 0.0))
        for part, weight in c.parts:
            total = total + weight * curve_column(part, curves, x, (*seen, name))
        return total
    raise ValueError(f"unknown curve {c.kind}")


def gaussian(x: np.ndarray, amplitude: float, mean: float, sigma: float) -> np.ndarray:
    return amplitude * np.exp(-0.5 * ((x - mean) / max(abs(sigma), 1e-9)) ** 2)


def smooth(y: np.ndarray, half: int) -> np.ndarray:
    """Centred moving average, shorter at the ends."""
    if half <= 0:
        return y
    total = np.concatenate([[0.0], np.cumsum(y)])
    a, b = np.maximum(np.arange(len(y)) - half, 0), np.minimum(np.arange(len(y)) + half + 1, len(y))
    return (total[b] - total[a]) / (b - a)
