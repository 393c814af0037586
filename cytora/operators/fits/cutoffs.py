"""Cutoff of an index channel from its survival curve: a straight line and a log-logistic curve, each trusted as far as the other errs."""

from __future__ import annotations

import numpy as np

# The arcsinh cofactor of the axis, the slope from which a line falls, and the relative slope at which the
# log-logistic curve leaves its plateau.
COFACTOR, FALLING, LEAVES = 5.0, -1e-12, 0.1
#: Grid of the two parameters in which the log-logistic curve isn't linear, and how often it is drawn closer.
GRID, ZOOMS = 41, 12


def line_cutoff(t: np.ndarray, y: np.ndarray) -> tuple[float | None, float]:
    """(where the regression line reaches half its intercept, sum of squares)."""
    slope, intercept = np.polynomial.Polynomial.fit(t, y, 1, domain=[0, 1], window=[0, 1]).coef[::-1] if np.ptp(t) > 0 else (0.0, float(y.mean()))
    error = float(((y - slope * t - intercept) ** 2).sum())
    return (float(-intercept / (2 * slope)) if slope < FALLING else None), error


def log_logistic(t: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    """(height, steepness, middle, sum of squares) of ``height / (1 + (t / middle) ** steepness)``.

    For given steepness and middle the best height is a ratio of sums, so a grid over the two is searched whole and
    drawn closer around its best point.
    """
    log_t = np.log(t)
    k_range, m_range = (np.log(0.2), np.log(80.0)), (float(log_t.min()) - 1, float(log_t.max()) + np.log(2))
    best = (0.0, 1.0, 1.0, np.inf)
    for _ in range(ZOOMS):
        k, m = np.exp(np.linspace(*k_range, GRID)), np.linspace(*m_range, GRID)
        shape = 1 / (1 + np.exp(np.clip(k[:, None, None] * (log_t - m[None, :, None]), -60, 60)))
        height = np.maximum((shape @ y) / np.maximum((shape * shape).sum(axis=2), 1e-300), 1e-12)
        error = ((height[:, :, None] * shape - y) ** 2).sum(axis=2)
        i, j = np.unravel_index(int(np.argmin(error)), error.shape)
        if error[i, j] < best[3]:
            best = (float(height[i, j]), float(k[i]), float(np.exp(m[j])), float(error[i, j]))
        # a quarter of the span around the best point so far
        k_span, m_span = (k_range[1] - k_range[0]) / 8, (m_range[1] - m_range[0]) / 8
        k_range = (np.log(best[1]) - k_span, np.log(best[1]) + k_span)
        m_range = (np.log(best[2]) - m_span, np.log(best[2]) + m_span)
    return best


def curve_cutoff(t: np.ndarray, steepness: float, middle: float) -> float | None:
    """First point at which the curve falls by more than ``LEAVES`` of its value per unit."""
    z = np.exp(np.clip(steepness * np.log(t / middle), -700, 700))
    leaving = np.flatnonzero(steepness * z / (t * (1 + z)) > LEAVES)
    return float(t[leaving[0]]) if len(leaving) else None


def index_cutoff(x: np.ndarray, share: np.ndarray, cofactor: float = COFACTOR) -> float | None:
    """Cutoff in units of the channel, from its survival curve at points that rise from 0; None where neither model gives one within the range."""
    t, y = np.arcsinh(np.asarray(x, float) / cofactor), np.asarray(share, float)
    if len(t) < 4 or not t[-1] > 0:
        return None
    held = lambda v: v if v is not None and 0 <= v <= t[-1] else None
    line, line_error = line_cutoff(t, y)
    rising = t > 0
    _, steepness, middle, curve_error = log_logistic(t[rising], y[rising])
    candidates = [(held(line), curve_error), (curve_cutoff(t[rising], steepness, middle), line_error)]
    given = [(v, w) for v, w in candidates if v is not None]
    if not given:
        return None
    weight = sum(w for _, w in given)
    found = held(sum(v * w for v, w in given) / weight if len(given) > 1 and weight > 1e-20 else float(np.mean([v for v, _ in given])))
    return None if found is None else float(cofactor * np.sinh(found))
