"""Populations of mutually similar events within each group.

Marker channels are brought to an arcsinh scale and standardised by the group's mean and spread on each. Features are
reduced to the channels that tell events apart: those with several density levels, and those along which a component
turns out to be two. A Gaussian mixture with regularised full covariances and a uniform background is fitted by
expectation-maximisation over every event until its likelihood settles. The Bayesian information criterion chooses the
number of components both ways: the fit starts from the cells between the density valleys of the channels, components
are merged as long as the criterion improves, and a component that shows a valley along one of its own principal directions
is split if the criterion improves. An event belongs to the component that explains it best, unless it lies outside
that component's reach or the background explains it better.

A fit is a sequence of passes, each of which adds up sums over events (histograms, cells, moments). A group up to
``HOT_ROWS`` rows is one task that makes all passes; of larger ones, many tasks add up the sums of their shares of
the events, which are written once and stay where they are, so that no task holds a group, and the result is that of the undivided group.

Defined results: events with a null array, a wrong number of values or a value that is not finite belong to no
population; an event_id delivered twice counts once; groups without channel rows give nothing; a null group_id
or event_id is left out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from cytora.operators.channels import MARKER_KINDS, kind_column
from cytora.session import hashed, materialise

#: Events a population has at least, and rows of a group from which it is split into chunks of so many rows.
MIN_EVENTS, HOT_ROWS = 20, 250_000
#: Arcsinh cofactors by kind of channel: counts of a mass channel, light of the others.
MASS_COFACTOR, LIGHT_COFACTOR = 5.0, 150.0
#: Histogram grid, smoothing width and depth of a valley (both on the arcsinh scale and as a share of the lower peak),
#: and the standard errors of its counts that a valley lies below the lower peak.
BIN, SMOOTH, VALLEY, NOISE = 0.05, 0.2, 0.5, 3.5
_LOW, _BINS = -12.0, 640
#: Floor of a standard deviation on the arcsinh scale and the tail beyond a component's reach.
MIN_SD, TAIL_SDS = 0.05, 4.9
#: Change of the mean log likelihood of an event below which a fit has settled, and limits that keep a fit from going on for ever.
SETTLED, MOST_STEPS, MOST_ROUNDS = 1e-4, 60, 12
#: Grid, smoothing and noise of the search for valleys along principal directions, in standard deviations of a component there;
#: loading from which a channel takes part in a split.
ALONG_BIN, ALONG_SMOOTH, ALONG_NOISE, LOADS = 0.04, 0.15, 5.0, 0.3
_ALONG = 400
#: Groups whose hot fits run together; what every task is given holds a model for each.
WAVE = 256

class Model(NamedTuple):
    """A mixture over the used channels of standardised events: weights, means, covariances, and the background's weight and density."""

    centre: np.ndarray
    scale: np.ndarray
    used: np.ndarray
    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    background: float
    log_uniform: float


def transform(values: np.ndarray, cofactors: np.ndarray) -> np.ndarray:
    """Marker columns (cofactor > 0) of the raw matrix on the arcsinh scale."""
    keep = cofactors > 0
    return np.arcsinh(values[:, keep].astype(np.float64) / cofactors[keep])


def histograms(y: np.ndarray) -> np.ndarray:
    """Counts of every channel on the fixed grid."""
    at = np.clip(((y - _LOW) / BIN).astype(np.int64), 0, _BINS - 1)
    return np.stack([np.bincount(at[:, j], minlength=_BINS) for j in range(y.shape[1])]) if y.shape[1] else np.zeros((0, _BINS), dtype=np.int64)


def valleys(counts: np.ndarray, low: float = _LOW, bin_: float = BIN, smooth: float = SMOOTH, noise: float = NOISE) -> list[float]:
    """Cut points of one histogram: the lowest places between two peaks of the smoothed density, if low enough."""
    width = int(4 * smooth / bin_)
    kernel = np.exp(-0.5 * (np.arange(-width, width + 1) * bin_ / smooth) ** 2)
    s = np.convolve(counts, kernel / kernel.sum(), "same")
    least = MIN_EVENTS * 0.25 * bin_ / smooth / 2.5  # in events, so that a population counts in a group of any size
    share = (kernel**2).sum() / kernel.sum() ** 2  # variance of a smoothed count over its mean
    inner = np.flatnonzero((s[1:-1] >= s[:-2]) & (s[1:-1] > s[2:]) & (s[1:-1] >= least)) + 1
    cuts: list[float] = []
    last = -1
    for p in inner:
        if last < 0:
            last = p
            continue
        v = last + int(np.argmin(s[last : p + 1]))
        lower = min(s[last], s[p])
        if s[v] < VALLEY * lower and lower - s[v] > noise * np.sqrt(share * (lower + s[v])):
            flat = np.flatnonzero(s[last : p + 1] <= s[v] * 1.0001 + 1e-12) + last
            cuts.append(low + (float(flat.mean()) + 0.5) * bin_)
            last = p
        elif s[p] > s[last]:
            last = p
    return cuts


def patterns(y: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """Number of the cell between the cuts that each event lies in."""
    code = np.zeros(len(y), dtype=np.uint64)
    for j, c in enumerate(cuts):
        if c:  # an odd factor loses no channel when many of them overflow
            code = code * np.uint64(0x9E3779B97F4A7C15) + np.searchsorted(c, y[:, j]).astype(np.uint64) + np.uint64(1)
    return code.view(np.int64)


def _log_density(y: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log density and squared distance under one component."""
    low = np.linalg.cholesky(cov)
    z = np.linalg.solve(low, (y - mean).T)
    distance = np.einsum("ij,ij->j", z, z)
    return -0.5 * (distance + len(mean) * np.log(2 * np.pi)) - np.log(np.diag(low)).sum(), distance


def _regular(n: float, cov: np.ndarray, pooled: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Covariance drawn towards the pooled variances as far as a component has few events, with a floor on each channel."""
    prior = len(cov) + 2.0
    out = (n * cov + prior * np.diag(np.diag(pooled))) / (n + prior)
    return out + np.diag(floor**2)


def _price(d: int, total: int) -> float:
    """What the information criterion asks for a component: half the logarithm of the events for each of its parameters."""
    return 0.5 * (d + d * (d + 1) / 2 + 1) * float(np.log(max(total, 2)))


def _worth(n: float, cov: np.ndarray, total: float) -> float:
    """Log likelihood of a component's own events, up to what all components share."""
    return -0.5 * n * float(np.linalg.slogdet(cov)[1]) + n * float(np.log(n / total))


def merged(n: np.ndarray, s: np.ndarray, q: np.ndarray, floor: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(events, means, covariances) of components made of cells given by their moments, merged while the information criterion improves."""
    d = s.shape[1]
    n = n.astype(float)
    mean = s / n[:, None]
    cov = q / n[:, None, None] - np.einsum("ki,kj->kij", mean, mean)
    pooled = np.tensordot(n, cov, axes=1) / n.sum() + np.diag(floor**2)
    price = _price(d, total)
    score = lambda k, c: _worth(k, _regular(k, c, pooled, floor), total)
    own = np.array([score(k, c) for k, c in zip(n, cov)])
    near = np.linalg.inv(pooled)
    while len(n) > 1:
        best, gain = None, 0.0
        for i in range(len(n)):
            gap = mean - mean[i]
            far = np.einsum("ij,jk,ik->i", gap, near, gap)
            for j in np.flatnonzero(far < 16 * d):
                if j <= i:
                    continue
                k = n[i] + n[j]
                step = gap[j]
                both = (n[i] * cov[i] + n[j] * cov[j]) / k + np.outer(step, step) * n[i] * n[j] / k**2
                change = score(k, both) - own[i] - own[j] + price
                if change > gain:
                    best, gain = (i, j, k, both), change
        if best is None:
            break
        i, j, k, both = best
        mean[i] = (n[i] * mean[i] + n[j] * mean[j]) / k
        n[i], cov[i], own[i] = k, both, score(k, both)
        keep = np.arange(len(n)) != j
        n, mean, cov, own = n[keep], mean[keep], cov[keep], own[keep]
    return n, mean, np.array([_regular(k, c, pooled, floor) for k, c in zip(n, cov)])


def expect(model: Model, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of standardised events: responsibilities (background last), log densities under the components, squared distances, log likelihoods."""
    x = z[:, model.used]
    k = len(model.weights)
    logs, distance = np.empty((len(x), k + 1)), np.empty((len(x), k))
    for i in range(k):
        logs[:, i], distance[:, i] = _log_density(x, model.means[i], model.covs[i])
    logs[:, :k] += np.log(model.weights)
    logs[:, k] = model.log_uniform + np.log(max(model.background, 1e-12))
    top = logs.max(axis=1, keepdims=True)
    resp = np.exp(logs - top)
    total = resp.sum(axis=1, keepdims=True)
    resp /= total
    return resp, logs[:, :k], distance, (top + np.log(total))[:, 0]


def maximise(model: Model, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> Model:
    """The next model from the summed moments; components that lost their events go."""
    total = n.sum()
    keep = n[:-1] >= MIN_EVENTS / 2
    if not keep.any():
        return model
    floor = MIN_SD / model.scale[model.used]
    k = n[:-1][keep]
    means = s[keep] / k[:, None]
    raw = q[keep] / k[:, None, None] - np.einsum("ki,kj->kij", means, means)
    pooled = np.tensordot(k, raw, axes=1) / k.sum() + np.diag(floor**2)
    covs = np.array([_regular(a, c, pooled, floor) for a, c in zip(k, raw)])
    return model._replace(weights=k / total, means=means, covs=covs, background=max(float(n[-1] / total), 1e-9))


def _reach(d: int) -> float:
    """Squared distance that a share of a normal component equal to the ``TAIL_SDS`` tail lies beyond (Wilson-Hilferty)."""
    return d * (1 - 2 / (9 * d) + TAIL_SDS * np.sqrt(2 / (9 * d))) ** 3


def assign(model: Model, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component of each event (on the arcsinh scale), -1 for none, and its log density there."""
    resp, logs, distance, _ = expect(model, (y - model.centre) / model.scale)
    best = resp.argmax(axis=1)
    none = best == len(model.weights)
    best = np.where(none, 0, best)
    at = np.arange(len(y))
    none |= distance[at, best] > _reach(int(model.used.sum()))
    return np.where(none, -1, best), logs[at, best] - np.log(model.weights[best])


# --- the fit as a sequence of passes ---------------------------------------------------------------------------


@dataclass
class Fit:
    """Where the fit of one group stands: the pass it needs next, and what earlier ones found."""

    stage: str = "levels"
    total: int = 0
    counts: np.ndarray | None = None
    cuts: list[list[float]] = field(default_factory=list)
    codes: np.ndarray | None = None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    model: Model | None = None
    likelihood: float = -np.inf
    steps: int = 0
    rounds: int = 0
    held: dict[str, np.ndarray] = field(default_factory=dict)
    directions: np.ndarray | None = None
    splits: list[tuple[int, np.ndarray, float]] = field(default_factory=list)


Sums = dict[str, np.ndarray]


def gather(fit: Fit, y: np.ndarray) -> Sums:
    """What the next pass needs of some events (on the arcsinh scale); sums over shares of the events add up (see ``add``)."""
    if fit.stage == "levels":
        return {"n": np.array([len(y)]), "counts": histograms(y)}
    if fit.stage == "codes":
        key, count = np.unique(patterns(y, fit.cuts), return_counts=True)
        return {"key": key, "count": count}
    z = (y - fit.centre) / fit.scale
    if fit.stage == "cells":
        code = patterns(y, fit.cuts)
        at = np.minimum(np.searchsorted(fit.codes, code), len(fit.codes) - 1)
        return _moments(np.where(fit.codes[at] == code, at, -1), z, len(fit.codes))
    model = fit.model
    if fit.stage == "step":
        resp, _, _, likelihood = expect(model, z)
        x, own = z[:, model.used], resp[:, :-1]
        products = np.stack([(own[:, i, None] * x).T @ x for i in range(own.shape[1])])  # one component at a time: memory of one copy of x
        return {"n": resp.sum(axis=0), "s": own.T @ x, "q": products, "likelihood": np.array([likelihood.sum()])}
    part, _ = assign(model, y)
    k = len(model.weights)
    if fit.stage == "spread":
        return _moments(part, z, k)
    if fit.stage == "along":
        out = np.zeros((k, z.shape[1], _ALONG), dtype=np.int64)
        for i in np.unique(part[part >= 0]):
            v = (z[part == i] - fit.held["mean"][i]) @ fit.directions[i].T
            at = np.clip((v / ALONG_BIN).astype(np.int64) + _ALONG // 2, 0, _ALONG - 1)
            out[i] = np.stack([np.bincount(at[:, j], minlength=_ALONG) for j in range(z.shape[1])])
        return {"counts": out}
    side = np.full(len(z), -1)
    for m, (i, direction, cut) in enumerate(fit.splits):
        own = part == i
        side[own] = 2 * m + ((z[own] - fit.held["mean"][i]) @ direction > cut)
    return _moments(side, z, 2 * len(fit.splits))


def _moments(part: np.ndarray, z: np.ndarray, k: int) -> Sums:
    """Count, sum and sum of outer products of the events of each part; -1 is none."""
    n, s, q = np.zeros(k), np.zeros((k, z.shape[1])), np.zeros((k, z.shape[1], z.shape[1]))
    order = np.argsort(part, kind="stable")
    own = part[order]
    for i, a, m in zip(*np.unique(own, return_index=True, return_counts=True)):
        if i >= 0:
            x = z[order[a : a + m]]
            n[i], s[i], q[i] = m, x.sum(axis=0), x.T @ x
    return {"n": n, "s": s, "q": q}


def add(parts: list[Sums]) -> Sums:
    """Sums of the shares of a group."""
    if "key" in parts[0]:
        key, place = np.unique(np.concatenate([p["key"] for p in parts]), return_inverse=True)
        return {"key": key, "count": np.bincount(place, weights=np.concatenate([p["count"] for p in parts]), minlength=len(key)).astype(np.int64)}
    return {c: np.sum([p[c] for p in parts], axis=0) for c in parts[0]}


def advance(fit: Fit, sums: Sums) -> Fit:
    """The fit after a pass, with the stage it needs next: ``done`` at the end, with a model unless no component was found."""
    done = lambda: replace(fit, stage="done", held={}, counts=None, codes=None, directions=None, splits=[])
    if fit.stage == "levels":
        counts, total = sums["counts"], int(sums["n"][0])
        if total < MIN_EVENTS or not len(counts):
            return replace(fit, stage="done")
        middle = _LOW + (np.arange(_BINS) + 0.5) * BIN
        n = np.maximum(counts.sum(axis=1), 1)
        centre = counts @ middle / n
        scale = np.sqrt(np.maximum(counts @ middle**2 / n - centre**2, MIN_SD**2))
        return replace(fit, stage="codes", total=total, counts=counts, cuts=[valleys(c) for c in counts], centre=centre, scale=scale)
    if fit.stage == "codes":
        codes = sums["key"][sums["count"] >= MIN_EVENTS // 2]
        return replace(fit, stage="cells", codes=codes) if len(codes) else done()
    if fit.stage == "cells":
        used = np.array([len(c) > 0 for c in fit.cuts])
        used = used if used.any() else np.ones(len(used), dtype=bool)
        n, mean, cov = merged(sums["n"], sums["s"][:, used], sums["q"][:, used][:, :, used], MIN_SD / fit.scale[used], fit.total)
        return replace(fit, stage="step", model=_model(fit, used, n, mean, cov), codes=None)
    if fit.stage == "step":
        mean = float(sums["likelihood"][0]) / fit.total
        if fit.steps and (mean - fit.likelihood < SETTLED or fit.steps >= MOST_STEPS):
            return replace(fit, stage="spread") if fit.rounds < MOST_ROUNDS else done()
        return replace(fit, model=maximise(fit.model, sums["n"], sums["s"], sums["q"]), likelihood=mean, steps=fit.steps + 1)
    if fit.stage == "spread":
        n = sums["n"]
        mean = sums["s"] / np.maximum(n, 1)[:, None]
        cov = sums["q"] / np.maximum(n, 1)[:, None, None] - np.einsum("ki,kj->kij", mean, mean)
        directions = np.zeros_like(cov)
        for i in np.flatnonzero(n >= 2 * MIN_EVENTS):
            values, axes = np.linalg.eigh(cov[i])
            directions[i] = (axes / np.sqrt(np.maximum(values, 1e-9))).T
        return replace(fit, stage="along", held={**sums, "mean": mean, "cov": cov}, directions=directions)
    if fit.stage == "along":
        splits = []
        for i in np.flatnonzero(fit.held["n"] >= 2 * MIN_EVENTS):
            best: tuple[float, int, float] | None = None
            for j, c in enumerate(sums["counts"][i]):
                for cut in valleys(c, -ALONG_BIN * _ALONG / 2, ALONG_BIN, ALONG_SMOOTH, ALONG_NOISE):
                    left = c[: int((cut + ALONG_BIN * _ALONG / 2) / ALONG_BIN)].sum()
                    even = min(left, c.sum() - left)
                    if even >= MIN_EVENTS and (best is None or even > best[0]):
                        best = (even, j, cut)
            if best is not None:
                splits.append((int(i), fit.directions[i][best[1]], best[2]))
        return replace(fit, stage="sides", splits=splits, directions=None) if splits else done()
    return _split(fit, sums, done)


def _split(fit: Fit, sums: Sums, done) -> Fit:
    """Components that are two by the information criterion become two; channels along which they part join the features."""
    n, s, q = fit.held["n"], fit.held["s"], fit.held["q"]
    used, parted = fit.model.used.copy(), []
    for m, (i, direction, _) in enumerate(fit.splits):
        weight = np.abs(direction) * np.sqrt(np.maximum(np.diag(fit.held["cov"][i]), 1e-12))
        own = fit.model.used | (weight >= LOADS * weight.max())
        floor = MIN_SD / fit.scale[own]
        cov = lambda k, a, b: b[np.ix_(own, own)] / k - np.outer(a[own], a[own]) / k**2 + np.diag(floor**2)
        halves = [(sums["n"][h], sums["s"][h], sums["q"][h]) for h in (2 * m, 2 * m + 1)]
        if min(h[0] for h in halves) < MIN_EVENTS:
            continue
        gain = sum(_worth(k, cov(k, a, b), fit.total) for k, a, b in halves) - _worth(n[i], cov(n[i], s[i], q[i]), fit.total)
        if gain > _price(int(own.sum()), fit.total):
            parted.append((i, halves))
            used |= own
    if not parted:
        return done()
    gone = {i for i, _ in parted}
    rows = [(n[i], s[i], q[i]) for i in range(len(n)) if i not in gone and n[i] >= MIN_EVENTS / 2] + [h for _, halves in parted for h in halves]
    k = np.array([r[0] for r in rows])
    floor = MIN_SD / fit.scale[used]
    mean = np.array([r[1][used] / r[0] for r in rows])
    raw = np.array([r[2][np.ix_(used, used)] / r[0] for r in rows]) - np.einsum("ki,kj->kij", mean, mean)
    pooled = np.tensordot(k, raw, axes=1) / k.sum() + np.diag(floor**2)
    covs = np.array([_regular(a, c, pooled, floor) for a, c in zip(k, raw)])
    return replace(fit, stage="step", model=_model(fit, used, k, mean, covs), likelihood=-np.inf, steps=0, rounds=fit.rounds + 1, held={}, splits=[])


def _model(fit: Fit, used: np.ndarray, n: np.ndarray, means: np.ndarray, covs: np.ndarray) -> Model:
    """A mixture whose background takes the events that no component holds, spread evenly over what the group spans."""
    rest = max(fit.total - float(n.sum()), 1.0)
    span = np.array([(np.ptp(np.flatnonzero(c)) * BIN + 2 * SMOOTH) / s for c, s, u in zip(fit.counts, fit.scale, used) if u])
    return Model(fit.centre, fit.scale, used, n / (n.sum() + rest), means, covs, rest / (n.sum() + rest), -float(np.log(span).sum()))


def fit_group(y: np.ndarray) -> Model | None:
    """The model of a whole group that fits one task."""
    fit = Fit()
    while fit.stage != "done":
        fit = advance(fit, gather(fit, y))
    return fit.model


def _matrix(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(event ids, raw matrix) of the rows whose arrays have ``width`` finite values, each event_id once."""
    ids = table.column("event_id").to_numpy()
    lists = table.column("event_values").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], lists.type)
    length = np.array(lists.value_lengths().fill_null(-1))
    good = np.flatnonzero(length == width)
    if not len(good) or not width:
        return ids[:0], np.zeros((0, width), dtype=np.float32)
    offsets = np.array(lists.offsets)
    flat = lists.values.to_numpy(zero_copy_only=False)
    x = flat[offsets[good][:, None] + np.arange(width)[None, :]]
    finite = np.isfinite(x).all(axis=1)
    ids, x = ids[good][finite], x[finite]
    ids, first = np.unique(ids, return_index=True)
    return ids, x[first]


def _group_table(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    if not right.num_rows:
        return np.zeros(0, dtype=np.int64), np.zeros((0, 0))
    cofactors = np.array(right.column("cofactors")[0].as_py(), dtype=float)
    ids, x = _matrix(left, len(cofactors))
    return ids, transform(x, cofactors)


_ASSIGNED = "event_id long, cluster_id long, log_density double"
_ASSIGNED_ARROW = pa.schema([("event_id", pa.int64()), ("cluster_id", pa.int64()), ("log_density", pa.float64())])


def _cluster_ids(ids: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Smallest event id of each event's population; -1 for populations that are too small."""
    out = np.full(len(ids), -1, dtype=np.int64)
    for k in np.unique(part[part >= 0]):
        own = part == k
        if own.sum() >= MIN_EVENTS:
            out[own] = ids[own].min()
    return out


def _whole_group(left: pa.Table, right: pa.Table) -> pa.Table:
    ids, y = _group_table(left, right)
    if len(ids) < MIN_EVENTS or not y.shape[1]:
        return _ASSIGNED_ARROW.empty_table()
    model = fit_group(y)
    if model is None:
        return _ASSIGNED_ARROW.empty_table()
    part, density = assign(model, y)
    cluster = _cluster_ids(ids, part)
    keep = cluster >= 0
    return pa.table({"event_id": ids[keep], "cluster_id": cluster[keep], "log_density": density[keep]}, schema=_ASSIGNED_ARROW)


def channel_cofactors(channels: DataFrame) -> DataFrame:
    """(group_id, cofactors): one entry per channel in channel_idx order, 0 for channels that are no markers."""
    kind = kind_column(F.col("channel_kind"), F.col("channel_name"))
    cofactor = F.when(kind == "Mass", MASS_COFACTOR).when(kind.isin(*MARKER_KINDS), LIGHT_COFACTOR).otherwise(0.0)
    rows = channels.select("group_id", F.col("channel_idx").cast("int").alias("channel_idx"), cofactor.alias("cofactor")).filter("group_id IS NOT NULL AND channel_idx IS NOT NULL")
    flat = rows.groupBy("group_id", "channel_idx").agg(F.max("cofactor").alias("cofactor"))
    listed = F.array_sort(F.collect_list(F.struct("channel_idx", "cofactor")))
    return flat.groupBy("group_id").agg(F.transform(listed, lambda c: c["cofactor"]).alias("cofactors"))


def _each_group(batches: Iterator[pa.RecordBatch], cofactors: dict[str, np.ndarray]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(group, event ids, events on the arcsinh scale) of the rows of a task, in pieces."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        names = table.column("group_id").to_pylist()
        for g in dict.fromkeys(names):
            if g in cofactors:
                ids, x = _matrix(table.filter(pc.equal(table.column("group_id"), g)), len(cofactors[g]))
                if len(ids):
                    yield g, ids, transform(x, cofactors[g])


def _hot_clusters(events: DataFrame, cofactors: DataFrame, hot: DataFrame) -> DataFrame:
    """Populations of groups of more than ``HOT_ROWS`` rows, by the same passes over shares of their events.

    Events are written once, each event_id in one place, and read where they lie by every pass; groups go in waves, so that what
    tasks are given stays small.
    """
    spark = events.sparkSession
    waves = hot.withColumn("wave", F.floor((F.row_number().over(Window.orderBy("group_id")) - 1) / WAVE).cast("int"))  # one row for every HOT_ROWS events at most
    per_task = F.pmod(F.xxhash64("event_id"), F.col("chunks")).cast("int").alias("chunk")
    keyed = events.join(waves, "group_id").select("wave", "group_id", per_task, "event_id", "event_values")
    total = hot.agg(F.sum("chunks")).first()[0]
    placed = keyed.repartition(max(int(total), spark.sparkContext.defaultParallelism), "group_id", "chunk").sortWithinPartitions("group_id", "event_id")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose event_id differs from the one before: an id delivered twice stands twice in one task."""
        last: tuple[object, object] | None = None
        for batch in batches:
            if batch.num_rows:
                ids, groups = batch.column("event_id").to_numpy(), batch.column("group_id")
                same = np.r_[last is not None and (groups[0].as_py(), ids[0]) == last, ids[1:] == ids[:-1]]
                last = (groups[len(ids) - 1].as_py(), ids[-1])
                yield batch.filter(pa.array(~same))

    rows = materialise(placed.drop("chunk").mapInArrow(once, "wave int, group_id string, event_id long, event_values array<float>"), ["wave"])
    results = None
    for wave in range(int(waves.agg(F.max("wave")).first()[0]) + 1):
        own = rows.filter(F.col("wave") == wave).drop("wave")
        known = {r["group_id"]: np.array(r["cofactors"], dtype=float) for r in cofactors.join(waves.filter(F.col("wave") == wave), "group_id").collect()}
        known = {g: c for g, c in known.items() if (c > 0).any()}
        fits = {g: Fit() for g in known}
        while open_ := {g: f for g, f in fits.items() if f.stage != "done"}:
            for g, sums in _pass(own, open_, known).items():
                fits[g] = advance(fits[g], sums)
            for g in open_:
                if fits[g] is open_[g]:  # a group without usable events
                    fits[g] = replace(fits[g], stage="done")
        models = {g: f.model for g, f in fits.items() if f.model is not None}
        shared = spark.sparkContext.broadcast((models, known))

        def place(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            models, known = shared.value
            for g, ids, y in _each_group(batches, {g: known[g] for g in models}):
                part, density = assign(models[g], y)
                in_one = part >= 0
                yield pa.RecordBatch.from_arrays([pa.array([g] * int(in_one.sum()), pa.string()), pa.array(ids[in_one]), pa.array(part[in_one].astype(np.int32)), pa.array(density[in_one])], names=["group_id", "event_id", "part", "log_density"])

        found = own.mapInArrow(place, "group_id string, event_id long, part int, log_density double")
        results = found if results is None else results.unionByName(found)
    placed_ = materialise(results)
    named = placed_.groupBy("group_id", "part").agg(F.min("event_id").alias("cluster_id"), F.count(F.lit(1)).alias("events")).filter(F.col("events") >= MIN_EVENTS)
    return placed_.join(named.select("group_id", "part", "cluster_id"), ["group_id", "part"]).select("event_id", "cluster_id", "log_density")


def _pass(rows: DataFrame, fits: dict[str, Fit], cofactors: dict[str, np.ndarray]) -> dict[str, Sums]:
    """The sums of one pass of every group, added up by tasks before they reach the driver: one per group."""
    shared = rows.sparkSession.sparkContext.broadcast((fits, {g: cofactors[g] for g in fits}))

    def collect_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, known = shared.value
        held: dict[str, Sums] = {}
        for g, _, y in _each_group(batches, known):
            new = gather(fits[g], y)
            held[g] = add([held[g], new]) if g in held else new
        for g, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.string()), pa.array([pickle.dumps(sums)], pa.binary())], names=["group_id", "sums"])

    def together(key: tuple, table: pa.Table) -> pa.Table:
        total: Sums | None = None
        for raw in table.column("sums").to_pylist():
            new = pickle.loads(raw)
            total = new if total is None else add([total, new])
        return pa.table({"group_id": pa.array([key[0].as_py()], pa.string()), "sums": pa.array([pickle.dumps(total)], pa.binary())})

    parts = rows.mapInArrow(collect_sums, "group_id string, sums binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
    first = parts.groupBy("group_id", "salt").applyInArrow(together, "group_id string, sums binary")
    whole = first.groupBy("group_id").applyInArrow(together, "group_id string, sums binary")
    return {r["group_id"]: pickle.loads(r["sums"]) for r in whole.collect()}


def populations(events: DataFrame, channels: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(event_id, cluster_id, log_density): events in a population, named by the smallest event_id in it."""
    rows = events.select("group_id", F.col("event_id").cast("long").alias("event_id"), F.col("event_values").cast("array<float>").alias("event_values")).filter("group_id IS NOT NULL AND event_id IS NOT NULL AND event_values IS NOT NULL")
    cofactors = channel_cofactors(channels)
    sizes = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows)
    hot = sizes.select("group_id", F.ceil(F.col("n") * 4 / hot_rows).alias("chunks"))  # four tasks for what one would else take
    hot = materialise(hot)  # few rows: at most one for every ``hot_rows`` events
    many = hot.count()
    cold = rows.join(hot.select("group_id"), "group_id", "left_anti") if many else rows
    out = hashed(cold, "group_id").groupBy("group_id").cogroup(hashed(cofactors, "group_id").groupBy("group_id")).applyInArrow(_whole_group, _ASSIGNED)
    return out.unionByName(_hot_clusters(rows, cofactors, hot)) if many else out


def found(events: DataFrame, channels: DataFrame) -> DataFrame:
    """Distinct (event_id, cluster_id)."""
    return populations(events, channels).select("event_id", "cluster_id")


def describe(assigned: DataFrame, typical: int = 5) -> DataFrame:
    """(cluster_id, events, typical): size of each population and its members of highest density, ties by event_id.

    Every task keeps the best ``typical`` members of each population it meets, so that no list grows with a population.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict[int, int] = {}
        ids = np.zeros(0, dtype=np.int64)
        cluster = np.zeros(0, dtype=np.int64)
        density = np.zeros(0)
        for batch in batches:
            own = batch.column("cluster_id").to_numpy()
            for c, n in zip(*np.unique(own, return_counts=True)):
                sizes[int(c)] = sizes.get(int(c), 0) + int(n)
            ids, cluster, density = np.concatenate([ids, batch.column("event_id").to_numpy()]), np.concatenate([cluster, own]), np.concatenate([density, batch.column("log_density").to_numpy()])
            order = np.lexsort((ids, -density, cluster))
            ids, cluster, density = ids[order], cluster[order], density[order]
            start = np.r_[True, cluster[1:] != cluster[:-1]]
            rank = np.arange(len(cluster)) - np.maximum.accumulate(np.where(start, np.arange(len(cluster)), 0))
            best = rank < typical
            ids, cluster, density = ids[best], cluster[best], density[best]
        first = np.r_[True, cluster[1:] != cluster[:-1]][: len(cluster)]
        n = np.where(first, [sizes[int(c)] for c in cluster], 0).astype(np.int64)  # the size on one of a population's rows
        yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(ids), pa.array(density), pa.array(n)], names=["cluster_id", "event_id", "log_density", "n"])

    best = assigned.select("cluster_id", "event_id", "log_density").mapInArrow(local, "cluster_id long, event_id long, log_density double, n long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.col("log_density").desc(), "event_id")))
    chosen = F.when(F.col("rank") <= typical, F.struct("rank", "event_id"))
    whole = ranked.groupBy("cluster_id").agg(F.sum("n").alias("events"), F.array_sort(F.collect_list(chosen)).alias("top"))
    return whole.select("cluster_id", "events", F.transform("top", lambda t: t["event_id"]).alias("typical"))
