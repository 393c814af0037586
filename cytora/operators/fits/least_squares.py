"""Bounded least squares by damped Gauss-Newton steps with projection onto the bounds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def least_squares(residual: Callable[[np.ndarray], np.ndarray], start: np.ndarray, lower: np.ndarray, upper: np.ndarray, evaluations: int = 1000, tolerance: float = 1e-10) -> tuple[np.ndarray, float]:
    """(parameters, sum of squares); parameters at a bound that the gradient pushes outwards stay there."""
    lower, upper = np.asarray(lower, float), np.asarray(upper, float)
    p = np.clip(np.asarray(start, float), lower, upper)
    r = residual(p)
    cost, used, damping = float(r @ r), 1, 1e-3
    while used < evaluations:
        j = np.empty((len(r), len(p)))
        for k in range(len(p)):
            h = 1e-7 * max(1.0, abs(p[k]))
            h = -h if p[k] + h > upper[k] else h
            q = p.copy()
            q[k] += h
            j[:, k] = (residual(q) - r) / h
        used += len(p)
        gradient = j.T @ r
        free = ~(((p <= lower) & (gradient > 0)) | ((p >= upper) & (gradient < 0)))
        if not free.any() or np.abs(gradient[free]).max() < 1e-14:
            break
        normal = j[:, free].T @ j[:, free]
        scale = np.maximum(np.diag(normal), 1e-12)
        better = False
        while damping < 1e12 and used < evaluations:
            try:
                step = np.linalg.solve(normal + damping * np.diag(scale), -gradient[free])
            except np.linalg.LinAlgError:
                damping *= 10
                continue
            q = p.copy()
            q[free] = np.clip(p[free] + step, lower[free], upper[free])
            s = residual(q)
            used += 1
            new = float(s @ s)
            if np.isfinite(new) and new < cost:
                better = cost - new > tolerance * max(cost, 1e-300)
                p, r, cost, damping = q, s, new, max(damping / 3, 1e-12)
                break
            damping *= 10
        if not better:
            break
    return p, cost
