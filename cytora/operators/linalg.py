"""Compensation and unmixing: small matrices on the driver, weighted column sums on the events."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytora.functions.exprs import weighted_sum

PIVOT, SAME = 1e-12, 1e-6


def inverse(m: np.ndarray) -> np.ndarray | None:
    """Inverse of a square matrix, or None where elimination with row exchange meets a pivot below 1e-12."""
    m = np.asarray(m, dtype=float)
    if m.ndim != 2 or m.shape[0] != m.shape[1] or not m.size or not np.isfinite(m).all():
        return None
    left, right = m.copy(), np.eye(len(m))
    for k in range(len(m)):
        p = k + int(np.argmax(np.abs(left[k:, k])))
        if abs(left[p, k]) < PIVOT:
            return None
        left[[k, p]], right[[k, p]] = left[[p, k]], right[[p, k]]
        d = left[k, k]
        left[k] /= d
        right[k] /= d
        others = np.arange(len(m)) != k
        right[others] -= np.outer(left[others, k], right[k])
        left[others] -= np.outer(left[others, k], left[k])
    return right


def is_identity(m: np.ndarray) -> bool:
    return bool(np.all(np.abs(np.asarray(m, dtype=float) - np.eye(len(m))) <= SAME))


def compensated(df: DataFrame, channels: list[str], matrix: np.ndarray | None, suffix: str = "") -> DataFrame:
    """``raw . M^-1`` for the named channels (rows are sources, columns receivers), single precision.

    A missing, identity or singular matrix and a missing channel leave the raw values, as event files expect.
    """
    inv = None
    if matrix is not None and len(matrix) and set(channels) <= set(df.columns) and not is_identity(matrix):
        inv = inverse(matrix)
    raw = [F.col(c) for c in channels if c in df.columns]
    values: dict[str, Column] = {}
    for j, c in enumerate(channels):
        if c in df.columns:
            values[c + suffix] = F.col(c).cast("float") if inv is None else weighted_sum(raw, list(inv[:, j])).cast("float")
    return df.withColumns(values)


def unmixed(array: str, coefficients: dict[str, list[float]]) -> dict[str, Column]:
    """Molecule columns from an array of detectors: the sum of detector times coefficient, single precision."""
    out = {}
    for name, weights in coefficients.items():
        w = F.array(*[F.lit(float(v)) for v in weights])
        products = F.zip_with(F.col(array), w, lambda a, b: a.cast("double") * b)
        out[name] = F.aggregate(products, F.lit(0.0), lambda s, p: s + p).cast("float")
    return out


def similarity_matrix(signatures: np.ndarray) -> np.ndarray:
    """Cosines between signatures (rows)."""
    s = np.asarray(signatures, dtype=float)
    norms = np.sum(s * s, axis=1) + 1e-9
    return (s @ s.T) / np.sqrt(np.outer(norms, norms))


def unmixing_matrix(signatures: np.ndarray) -> np.ndarray:
    """Molecules x detectors: pseudo-inverse of the mixing matrix; dependent signatures raise."""
    s = np.asarray(signatures, dtype=float)
    u, d, vt = np.linalg.svd(s.T, full_matrices=False)
    if len(d) < len(s) or d.min(initial=np.inf) <= d.max(initial=0.0) * max(s.shape) * np.finfo(float).eps:
        raise ValueError("signatures depend on each other")
    return (vt.T / d) @ u.T


class Registry:
    """Compensations of a group: equal ones are kept once, identity is always there."""

    def __init__(self, channels: list[str]):
        self.channels = list(channels)
        self.known: list[tuple[str, np.ndarray]] = [("Identity", np.eye(len(channels)))]
        self.chosen, self.by_hand = 0, False

    def add(self, name: str, channels: list[str], matrix: np.ndarray, from_file: bool = False) -> int:
        m = np.asarray(matrix, dtype=float)
        for i, (_, old) in enumerate(self.known):
            if list(channels) == self.channels and old.shape == m.shape and np.all(np.abs(old - m) <= SAME):
                return i
        if list(channels) != self.channels:
            raise ValueError("channels differ from the group's")
        names, base, k = {n for n, _ in self.known}, name, 2
        while name in names:
            name, k = f"{base} {k}", k + 1
        self.known.append((name, m))
        if from_file and not self.by_hand and self.chosen == 0:
            self.chosen = len(self.known) - 1
        return len(self.known) - 1

    def choose(self, index: int) -> None:
        self.chosen, self.by_hand = index, True
