"""Scalar expressions of event analysis as Spark columns, with the semantics event files need.

Spark orders NaN above every number and holds it equal to itself; event analysis holds every comparison with NaN
false. All comparisons here guard for that.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def fin(c: Column) -> Column:
    """True for a finite number; null, NaN and infinities are not."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF))


def f32(c: Column) -> Column:
    """Rounded to single precision, kept as double."""
    return c.cast("float").cast("double")


def at_least(x: Column, v: float | Column) -> Column:
    return F.coalesce(~F.isnan(x) & (x >= v), F.lit(False))


def above(x: Column, v: float | Column) -> Column:
    return F.coalesce(~F.isnan(x) & (x > v), F.lit(False))


def at_most(x: Column, v: float | Column) -> Column:
    return F.coalesce(~F.isnan(x) & (x <= v), F.lit(False))


def below(x: Column, v: float | Column) -> Column:
    return F.coalesce(~F.isnan(x) & (x < v), F.lit(False))


def signed_log(c: Column) -> Column:
    return F.signum(c) * F.log10(F.lit(1.0) + F.abs(c))


def signed_log_inverse(c: Column) -> Column:
    return F.signum(c) * (F.pow(F.lit(10.0), F.abs(c)) - 1.0)


def arcsinh(c: Column) -> Column:
    """Inverse hyperbolic sine that stays exact for large negative input."""
    return F.signum(c) * F.ln(F.abs(c) + F.sqrt(c * c + 1.0))


class Logicle(NamedTuple):
    """Parameters of the biexponential scale: top, linear width, decades, negative decades."""

    t: float = 262144.0
    w: float = 0.3
    m: float = 3.0
    a: float = 0.0

    def constants(self) -> dict[str, float]:
        """Coefficients of ``a e^(b y) - c e^(-d y) - f`` that the parameters stand for."""
        span = self.m + self.a
        w, x2 = self.w / span, self.a / span
        x1, x0, b = x2 + w, x2 + 2 * w, span * math.log(10)
        d = self._decay(b, w)
        c_a = math.exp((b + d) * x0)
        mf_a = math.exp(b * x1) - c_a / math.exp(d * x1)
        top = math.exp(b) - mf_a - c_a / math.exp(d)
        a = self.t / top
        return {"a": a, "b": b, "c": c_a * a, "d": d, "f": mf_a * a, "w": w, "x1": x1, "x0": x0}

    @staticmethod
    def _decay(b: float, w: float) -> float:
        """Root in (0, b) of ``2 ln(d / b) + w (b + d)``, by bisection polished with Newton steps."""
        if w == 0:
            return b
        g = lambda d: 2 * (math.log(d) - math.log(b)) + w * (b + d)
        lo, hi = 1e-12 * b, b
        for _ in range(200):
            mid = 0.5 * (lo + hi)
            lo, hi = (mid, hi) if g(mid) < 0 else (lo, mid)
        d = 0.5 * (lo + hi)
        for _ in range(3):
            d -= g(d) / (2 / d + w)
        return d

    def inverse(self, y: Column) -> Column:
        """Data value of a position on the scale; a closed form, no Python involved."""
        k = self.constants()
        p = F.when(y < k["x1"], 2 * k["x1"] - y).otherwise(y)
        value = k["a"] * F.exp(k["b"] * p) - k["c"] * F.exp(-k["d"] * p) - k["f"]
        return F.when(y < k["x1"], -value).otherwise(value)

    def values(self, x: np.ndarray) -> np.ndarray:
        """Positions of data values, by Halley steps on all values at once; NaN stays NaN."""
        k = self.constants()
        x = np.asarray(x, dtype=np.float64)
        size = np.abs(x)
        finite = np.isfinite(size)
        y = np.where(size < k["a"], k["x1"] + size / max(self.t, 1e-300) * 0.1, np.log(np.maximum(size, 1e-300) / k["a"]) / k["b"])
        y = np.where(finite, np.maximum(y, k["x1"]), k["x1"])
        target = np.where(finite, size, 0.0)
        for _ in range(60):
            up, down = k["a"] * np.exp(k["b"] * y), k["c"] * np.exp(-k["d"] * y)
            value = up - down - k["f"] - target
            first, second = k["b"] * up + k["d"] * down, k["b"] ** 2 * up - k["d"] ** 2 * down
            step = value / first / np.maximum(1 - 0.5 * value * second / first**2, 0.25)
            y = y - step
            if np.nanmax(np.abs(step), initial=0.0) < 1e-13:
                break
        y = np.where(x < 0, 2 * k["x1"] - y, y)
        y = np.where(x == 0, k["x1"], y)
        return np.where(finite, y, np.where(np.isnan(x), np.nan, np.where(x > 0, np.inf, -np.inf)))


def logicle(c: Column, scale: Logicle = Logicle()) -> Column:
    """Position on the biexponential scale; vectorised over Arrow batches."""

    @F.pandas_udf(T.DoubleType())
    def forward(x: pd.Series) -> pd.Series:
        return pd.Series(scale.values(x.to_numpy(dtype=np.float64, na_value=np.nan)))

    return F.when(c.isNotNull(), forward(c.cast("double")))


class Axis(NamedTuple):
    """Range and scale of a plot axis: kind is ``linear``, ``log``, ``arcsinh`` or ``logicle``."""

    low: float = 0.0
    high: float = 262144.0
    kind: str = "linear"
    cofactor: float = 5.0
    logicle: Logicle = Logicle()

    def same_scale(self, other: Axis) -> bool:
        """Whether two axes place values alike up to their range: the same kind with the same parameters."""
        if self.kind != other.kind:
            return False
        if self.kind == "arcsinh":
            return abs(self._cofactor() - other._cofactor()) <= 1e-12
        return self.kind != "logicle" or self.logicle == other.logicle

    def forward(self, c: Column) -> Column:
        if self.kind == "linear":
            return c.cast("double")
        if self.kind == "log":
            return signed_log(c.cast("double"))
        if self.kind == "arcsinh":
            return arcsinh(c.cast("double") / F.lit(self._cofactor()))
        if self.kind == "logicle":
            return logicle(c, self.logicle)
        raise ValueError(f"unknown scale {self.kind}")

    def _cofactor(self) -> float:
        return self.cofactor if self.cofactor > 0 and math.isfinite(self.cofactor) else 5.0

    def number(self, v: float) -> float:
        if self.kind == "linear":
            return float(v)
        if self.kind == "log":
            return math.copysign(math.log10(1 + abs(v)), v)
        if self.kind == "arcsinh":
            return math.asinh(v / self._cofactor())
        return float(self.logicle.values(np.array([v]))[0])

    def normalised(self, c: Column) -> Column:
        """Position within the range as single precision; a range without span gives 0."""
        lo, hi = self.number(self.low), self.number(self.high)
        if not hi - lo > 0:
            return F.lit(0.0)
        return f32((self.forward(c) - F.lit(lo)) / F.lit(hi - lo))

    def normalised_number(self, v: float) -> float:
        lo, hi = self.number(self.low), self.number(self.high)
        return (self.number(v) - lo) / (hi - lo) if hi - lo > 0 else 0.0


def inside_polygon(x: Column, y: Column, vertices: Sequence[tuple[float, float]]) -> Column:
    """Even-odd test by a ray; edges are literals, so the whole test is one expression. NaN lies outside."""
    if len(vertices) < 3:
        return F.lit(False)
    crossings = []
    for (ax, ay), (bx, by) in zip(vertices, [*vertices[-1:], *vertices[:-1]]):
        if ay == by:
            continue
        spans = (F.lit(ay) > y) != (F.lit(by) > y)
        at = F.lit(bx - ax) * (y - ay) / F.lit(by - ay) + ax
        crossings.append((spans & (x < at)).cast("int"))
    if not crossings:
        return F.lit(False)
    odd = reduce(lambda p, q: p + q, crossings) % 2 == 1
    return F.coalesce(~F.isnan(x) & ~F.isnan(y) & odd, F.lit(False))


def weighted_sum(columns: Sequence[Column], weights: Sequence[float]) -> Column:
    return reduce(lambda p, q: p + q, [c.cast("double") * F.lit(float(w)) for c, w in zip(columns, weights)])


def spectral_display(c: Column) -> Column:
    return F.when(c <= 0, 0.0).when(c <= 1000, c / 1000).otherwise(1 + F.log10(c / 1000))
