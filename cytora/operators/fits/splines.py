"""Monotone cubics between quantiles (Fritsch and Carlson, 1980), in numpy and as Spark expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def knots(source: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, slopes) of the cubic through the points; equal sources are one knot of the mean goal, NaN is left out.

    Where fewer than two knots, or one goal only, are left there is nothing to bend: all three come out empty.
    """
    points = np.column_stack([source, goal]).astype(float)
    points = points[~np.isnan(points).any(axis=1)]
    x, place = np.unique(points[:, 0], return_inverse=True)
    y = np.bincount(place, weights=points[:, 1]) / np.bincount(place) if len(points) else np.zeros(0)
    if len(x) < 2 or np.ptp(y) == 0:
        return np.zeros(0), np.zeros(0), np.zeros(0)
    secant = np.diff(y) / np.diff(x)
    around = np.concatenate([secant[:1], secant, secant[-1:]])
    return x, y, _monotone((around[:-1] + around[1:]) / 2, secant)


def _monotone(slopes: np.ndarray, secant: np.ndarray) -> np.ndarray:
    """Slopes drawn into the region in which the cubic of every interval is monotone; intervals follow one another.

    With ``a`` and ``b`` the slopes at both ends over the secant, the region is ``a + 2 b <= 3``, ``2 a + b <= 3`` or
    ``a >= (2 a + b - 3)^2 / (3 (a + b - 2))``; a pair outside is drawn back to the circle of radius three.
    """
    m = slopes.copy()
    for i in range(len(secant)):
        d = secant[i]
        if d == 0:
            m[i : i + 2] = 0
            continue
        a, b = m[i : i + 2] / d
        if min(a + 2 * b, 2 * a + b) <= 3:
            continue
        if a * 3 * (a + b - 2) < (2 * a + b - 3) ** 2:
            m[i : i + 2] *= 3 / np.hypot(a, b)
    return m


def evaluate(x: np.ndarray, y: np.ndarray, slopes: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The cubic at ``v``, straight beyond the outer knots; without knots, ``v`` itself."""
    v = np.asarray(v, float)
    if not len(x):
        return v
    inner = np.clip(v, x[0], x[-1])
    i = np.clip(np.searchsorted(x, inner, side="right") - 1, 0, len(x) - 2)
    h = x[i + 1] - x[i]
    t = (inner - x[i]) / h
    bent = (1 - t) ** 2 * ((1 + 2 * t) * y[i] + t * h * slopes[i]) + t * t * ((3 - 2 * t) * y[i + 1] - (1 - t) * h * slopes[i + 1])
    return bent + np.where(v < x[0], slopes[0], slopes[-1]) * (v - inner)


def padded(x: np.ndarray, most: int) -> np.ndarray:
    """Knots in a row of a power of two places, at least one more than ``most``, filled up with infinity."""
    return np.concatenate([x, np.full((1 << int(most).bit_length()) - len(x), np.inf)])


def bent(df: DataFrame, channels: dict[str, tuple[str, str]], most: int) -> DataFrame:
    """``df`` with each channel replaced by its cubic; the two columns named hold the ``padded`` places of ``most`` knots at most, and the knots as structs (null: the value stays).

    A knot is found by bisection, one column a step, so that code is generated for all of it.
    """
    value = {c: F.col(c).cast("double") for c in channels}
    sound = {c: F.col(x).isNotNull() & value[c].isNotNull() & ~F.isnan(value[c]) for c, (x, _) in channels.items()}
    out = df.withColumns({f"_p_{c}": F.lit(0) for c in channels} | {f"_v_{c}": F.coalesce(value[c], F.lit(0.0)) for c in channels})
    jump = 1 << (int(most).bit_length() - 1)
    while jump:
        out = out.withColumns({f"_p_{c}": F.col(f"_p_{c}") + F.when(F.col(f"_v_{c}") >= F.get(x, F.col(f"_p_{c}") + jump), jump).otherwise(0) for c, (x, _) in channels.items()})
        jump >>= 1
    out = out.withColumns({f"_p_{c}": F.least(F.col(f"_p_{c}"), F.size(k) - 2) for c, (_, k) in channels.items()})
    out = out.withColumns({f"_a_{c}": F.get(k, F.col(f"_p_{c}")) for c, (_, k) in channels.items()} | {f"_b_{c}": F.get(k, F.col(f"_p_{c}") + 1) for c, (_, k) in channels.items()})
    out = out.withColumns({f"_h_{c}": F.col(f"_b_{c}.x") - F.col(f"_a_{c}.x") for c in channels} | {f"_i_{c}": F.least(F.greatest(F.col(f"_v_{c}"), F.col(f"_a_{c}.x")), F.col(f"_b_{c}.x")) for c in channels})
    out = out.withColumns({f"_t_{c}": (F.col(f"_i_{c}") - F.col(f"_a_{c}.x")) / F.col(f"_h_{c}") for c in channels})
    final = {}
    for c in channels:
        t, h, (y0, y1), (m0, m1), i, v = F.col(f"_t_{c}"), F.col(f"_h_{c}"), (F.col(f"_{n}_{c}.y") for n in "ab"), (F.col(f"_{n}_{c}.m") for n in "ab"), F.col(f"_i_{c}"), F.col(f"_v_{c}")
        inside = (1 - t) * (1 - t) * ((1 + 2 * t) * y0 + t * h * m0) + t * t * ((3 - 2 * t) * y1 - (1 - t) * h * m1)
        final[c] = F.when(sound[c], inside + F.when(v < i, m0).otherwise(m1) * (v - i)).otherwise(value[c])
    return out.withColumns(final).select(*df.columns)
