"""Histograms as mixtures: phases of the cell cycle and generations of dividing cells.

Both fits maximise the likelihood of the counts by expectation-maximisation: every bin is shared out among the
components in proportion to what each expects there, and each component is then the weighted moments of its share.
Shapes come from the literature on DNA histograms: peaks are normal (Dean and Jett, 1974), DNA synthesis between
them is a smooth curve, here of non-negative Bernstein polynomials of the second degree, with a normal wave of synchronous cells on
it (Fox, 1980), or is whatever the peaks leave (Watson, Chambers and Smith, 1987). Generations halve the dye, so on
a logarithmic axis their peaks form a ladder with even steps and one width.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np

from cytora.operators.fits.curves import gaussian
from cytora.operators.fits.special import normal_cdf

_TINY = 1e-300


class Peak(NamedTuple):
    """A normal peak: its share of all events, place and width."""

    share: float
    mean: float
    sigma: float

    def density(self, x: np.ndarray, width: float) -> np.ndarray:
        """Expected share of each bin of ``width``."""
        return gaussian(x, self.share * width / (self.sigma * math.sqrt(2 * math.pi)), self.mean, self.sigma)


def _summits(y: np.ndarray) -> np.ndarray:
    """Places that no neighbour within two bins exceeds."""
    padded = np.pad(y, 2, constant_values=-np.inf)
    around = np.lib.stride_tricks.sliding_window_view(padded, 5)
    return np.flatnonzero((y >= around.max(axis=1)) & (y > 0))


#: A second peak of DNA content is expected at twice the first; how far the ratio may spread around that.
RATIO, RATIO_SPREAD, LEAST_RATIO = 2.0, 0.25, 1.4


def phase_peaks(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Places of the first and the second phase: the highest summit, and the one that height and ratio speak for most."""
    one = int(np.argmax(y))
    base = x[one] if x[one] > 0 else max(float(np.ptp(x)) / 4, 1e-9)
    expected = x[one] + base * (RATIO - 1)
    later = _summits(y)
    later = later[(x[later] - x[one] >= base * (LEAST_RATIO - 1)) & (later > one)]
    if not len(later):
        return one, int(min(len(x) - 1, max(one + 1, np.searchsorted(x, expected))))
    likely = np.log(np.maximum(y[later], _TINY)) - 0.5 * ((x[later] - expected) / (RATIO_SPREAD * base)) ** 2
    return one, int(later[np.argmax(likely)])


def outer_half(x: np.ndarray, y: np.ndarray, at: int, side: int) -> Peak:
    """The normal peak whose outer half the histogram shows: second moments of the half, cut at three widths."""
    width = x[1] - x[0]
    mean = x[at]
    if 0 < at < len(x) - 1:  # the summit of the parabola through three bins
        bend = y[at - 1] - 2 * y[at] + y[at + 1]
        mean += width * float(np.clip(0.5 * (y[at - 1] - y[at + 1]) / bend, -0.5, 0.5)) if bend < 0 else 0.0
    out = (x - mean) * side
    half = np.where(out > 0, y, 0.0)
    half[at] = y[at] / 2
    sigma = float(np.ptp(x)) / 8
    for _ in range(30):
        use = out <= 3 * sigma
        mass = half[use].sum()
        if mass <= 0:
            return Peak(0.0, mean, max(sigma, width / 4))
        new = max(math.sqrt(float((half[use] * out[use] ** 2).sum() / mass) / 0.9733), width / 4)  # the variance that three widths hold
        if abs(new - sigma) < 1e-6 * width:
            break
        sigma = new
    share = 2 * float(mass) / 0.9973
    for _ in range(4):  # the summit of a noisy peak is uncertain: its logarithm is a parabola, fitted where nothing else lies
        use = ((x - mean) * side >= -0.3 * sigma) & ((x - mean) * side <= 2.2 * sigma) & (y > 0)
        if use.sum() < 4:
            break
        u = (x[use] - mean) / sigma
        c, b, a = np.polynomial.polynomial.polyfit(u, np.log(y[use]), 2, w=np.sqrt(y[use]))
        if a >= -0.05 or abs(b / (2 * a)) > 1:
            break
        mean, sigma, height = mean - sigma * b / (2 * a), max(sigma * math.sqrt(-0.5 / a), width / 4), math.exp(c - b * b / (4 * a))
        share = height * sigma * math.sqrt(2 * math.pi) / width
    return Peak(share, mean, sigma)


def _watson(x: np.ndarray, y: np.ndarray) -> tuple[Peak, Peak, np.ndarray]:
    one, two = phase_peaks(x, y)
    width = x[1] - x[0]
    first, second = outer_half(x, y, one, -1), outer_half(x, y, two, 1)
    left = np.maximum(y - first.density(x, width) - second.density(x, width), 0)
    between = normal_cdf((x - first.mean) / first.sigma) * normal_cdf((second.mean - x) / second.sigma)
    return first, second, np.where((x >= first.mean) & (x <= second.mean), left * between, 0.0)


def _dean_jett_fox(x: np.ndarray, y: np.ndarray, steps: int = 2000) -> tuple[Peak, Peak, np.ndarray]:
    one, two = phase_peaks(x, y)
    width = x[1] - x[0]
    total = max(float(y.sum()), _TINY)
    # peaks stand on the level of synthesis between them; both cycles' peaks have about one coefficient of variation
    level = float(np.median(y[one : two + 1]))
    first = outer_half(x, y, one, -1)
    sigmas = first.sigma, max(first.sigma * x[two] / x[one], width / 4) if x[one] > 0 else first.sigma
    first, second = (Peak(float(np.clip((y[at] - level) * s * math.sqrt(2 * math.pi) / (width * total), 0.01, 0.9)), float(x[at]), s) for at, s in zip((one, two), sigmas))
    synthesis = np.full(4, max(1 - first.share - second.share, 0.1) / 4)  # three polynomials and the wave
    wave = Peak(1.0, (first.mean + second.mean) / 2, (second.mean - first.mean) / 6)
    for _ in range(steps):
        t = (x - first.mean) / max(second.mean - first.mean, width)
        inside = (t >= 0) & (t <= 1)
        u = np.clip(t, 0, 1)
        shapes = np.stack([(1 - u) ** 2, 2 * u * (1 - u), u * u, np.exp(-0.5 * ((x - wave.mean) / wave.sigma) ** 2)]) * inside
        shapes /= np.maximum(shapes.sum(axis=1, keepdims=True), _TINY)
        parts = np.vstack([first.density(x, width), second.density(x, width), synthesis[:, None] * shapes])
        mine = parts / np.maximum(parts.sum(axis=0), _TINY) * (y / total)
        held = mine.sum(axis=1)
        moved = abs(held[0] - first.share) + abs(held[1] - second.share)
        place = mine @ x / np.maximum(held, _TINY)
        spread = np.sqrt(np.maximum((mine * (x[None, :] - place[:, None]) ** 2).sum(axis=1) / np.maximum(held, _TINY), (width / 4) ** 2))
        first = Peak(float(held[0]), float(place[0]), float(spread[0])) if held[0] > 1e-9 else first
        second = Peak(float(held[1]), float(place[1]), float(spread[1])) if held[1] > 1e-9 and place[1] > first.mean + width else second
        gap = second.mean - first.mean
        if held[5] > 1e-9:  # a wave stays narrower than the span it moves through
            wave = Peak(1.0, float(place[5]), float(np.clip(spread[5], 0.02 * gap, gap / 3)))
        synthesis = held[2:]
        if moved < 1e-7:
            break
    return first, second, (synthesis[:, None] * shapes).sum(axis=0) * total


def cell_cycle(x: np.ndarray, y: np.ndarray, model: str = "watson") -> dict[str, float]:
    """Phase percentages and peaks of a DNA histogram (bin centres, shares); ``model`` is watson or dean.

    Percentages add up to 100, or are 0 for an empty histogram; widths are given as coefficients of variation.
    """
    if model not in ("watson", "dean"):
        raise ValueError(f"unknown model {model}")
    x, y = np.asarray(x, float), np.maximum(np.asarray(y, float), 0)
    first, second, synthesis = (_watson if model == "watson" else _dean_jett_fox)(x, y)
    width = x[1] - x[0]
    scale = 1.0 if model == "watson" else max(float(y.sum()), _TINY)
    areas = np.array([first.density(x, width).sum() * scale, synthesis.sum(), second.density(x, width).sum() * scale])
    percent = 100 * areas / areas.sum() if areas.sum() > 0 else np.zeros(3)
    cv = lambda p: 100 * p.sigma / max(abs(p.mean), 1e-9)
    return {
        "g1": float(percent[0]), "s": float(percent[1]), "g2": float(percent[2]), "g1_mean": first.mean, "g1_cv": cv(first),
        "g2_mean": second.mean, "g2_cv": cv(second), "ratio": second.mean / max(first.mean, 1e-9),
    }


def synthesis_polynomial(x: np.ndarray, synthesis: np.ndarray, degree: int = 8) -> tuple[float, float, tuple[float, ...]]:
    """(minimum, maximum, coefficients): the polynomial in (x - minimum) / (maximum - minimum) nearest to a synthesis curve."""
    held = np.flatnonzero(synthesis > 0)
    if len(held) < 2:
        return float(x[0]), float(x[-1]), (0.0,)
    lo, hi = float(x[held[0]]), float(x[held[-1]])
    part = slice(held[0], held[-1] + 1)
    fitted = np.polynomial.Polynomial.fit((x[part] - lo) / (hi - lo), synthesis[part], min(degree, len(held) - 1), domain=[0, 1], window=[0, 1])
    return lo, hi, tuple(float(c) for c in fitted.coef)


# --- generations -----------------------------------------------------------------------------------------------

# Generations a fit has at most, how far a step may deviate from the ladder's, the widest peak
# against the step, and the share from which a generation counts as seen.
MOST_PEAKS, DISTORTION, WIDEST, SEEN = 33, 0.1, 0.48, 0.001


def _ladder(x: np.ndarray, y: np.ndarray, top: float, step: float, n: int, steps: int, loose: bool) -> tuple[float, np.ndarray, np.ndarray, float, float]:
    """(log likelihood, shares, means, width, step) of ``n`` peaks that begin at ``top`` and fall by ``step``."""
    k = np.arange(n)
    first, gap = step, step
    shares, sigma = np.full(n, 1 / n), 0.25 * step
    means = top - gap * k
    value = -math.inf
    for _ in range(steps):
        z = (x[None, :] - means[:, None]) / sigma
        parts = shares[:, None] * np.exp(-0.5 * z * z) / sigma + 1e-12
        expected = parts.sum(axis=0)
        new = float(y @ np.log(expected))
        mine = parts / expected * y
        held = np.maximum(mine.sum(axis=1), 1e-12)
        place = mine @ x / held
        # the straight line through the places, weighted by what each peak holds, is the next ladder
        centre = (held @ k) / held.sum()
        slope = -(held * (k - centre)) @ (place - (held @ place) / held.sum()) / max((held * (k - centre)) @ (k - centre), 1e-9)
        gap = float(np.clip(slope, 0.65 * first, 1.35 * first)) if n > 1 else gap
        top = float((held @ (place + gap * k)) / held.sum())
        means = top - gap * k
        if loose:  # single steps give way as far as the peak's own events ask for
            weight = held / (held + 0.02)
            means = means + np.clip(weight * (place - means), -DISTORTION * gap, DISTORTION * gap)
        sigma = float(np.clip(math.sqrt((mine * (x[None, :] - means[:, None]) ** 2).sum() / held.sum()), 0.5, WIDEST * gap))
        shares = held / held.sum()
        if abs(new - value) < 1e-9:
            break
        value = new
    return value, shares, means, sigma, gap


def proliferation(y: np.ndarray, generations: int = 8, prominence: float = 0.03) -> dict[str, np.ndarray | float]:
    """Shares and means of generations in a dye histogram, in units of its bins, and the division indices.

    The undivided cells are the brightest summit of at least ``prominence`` of the highest one; of all steps the ladder with
    the best information criterion is taken.
    """
    y = np.maximum(np.asarray(y, float), 0)
    bins = len(y)
    x = np.arange(bins) + 0.5
    share = y / max(y.sum(), _TINY)
    kernel = np.exp(-0.5 * (np.arange(-6, 7) / max(bins / 200, 1)) ** 2)
    even = np.convolve(share, kernel / kernel.sum(), "same")
    tall = [k for k in _summits(even) if even[k] >= max(prominence, 0.1) * even.max()] or [int(np.argmax(even))]
    parent = float(x[max(tall)])
    best = None
    for step in np.geomspace(bins / 40, bins / 4, 24):
        n = int(min(generations + 1, MOST_PEAKS, max(1, math.floor(parent / step) + 1)))
        found = _ladder(x, share, parent, step, n, 40, False)
        seen = int((found[1] >= SEEN).sum())
        score = found[0] - 0.5 * (seen + 2) * math.log(max(bins, 2)) / bins
        if best is None or score > best[0]:
            best = (score, n, found)
    _, n, (_, _, means, _, gap) = best
    _, fractions, means, sigma, gap = _ladder(x, share, float(means[0]), gap, n, 500, True)
    k = np.arange(n)
    divided = fractions[1:].sum()
    return {
        "fractions": fractions, "means": means, "width": sigma, "step": gap, "division": float(k @ fractions),
        "proliferation": float((k[1:] @ fractions[1:]) / max(divided, 1e-12)), "replication": float(fractions.sum() / max((fractions / 2.0**k).sum(), 1e-12)),
    }
