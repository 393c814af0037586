"""Implausible bins of measurement series: spikes, stuck values, impossible readings and broken clocks.

Every series is judged by itself. An isolation forest over level, difference, seasonal and run-length features
scores each reading, and only readings that the forest isolates early can be spikes; explicit physical limits decide
about impossible readings, stuck runs and times. A check of the shape follows: a spike returns within three bins to the
level that is held on both sides.

Series of up to ``WHOLE`` bins are judged many at a time. A longer one is cut into blocks with a halo, so that no task
holds it, and is still judged by the scatter, the season and the forest of the whole series: the scatter is an exact
order statistic, sums over lags and ranges add up over blocks, and trees are grown on rows drawn from all of it by hash.
Both ways draw the same rows and numbers, so they agree.

Defined results: bins that repeat (series_id, bin_idx) count once. A null reading is never a case by itself
and is skipped when levels and runs are formed; a null time is skipped in the order of times, which is judged within a block and its halo.
A series whose channel is unknown has no upper limit. Rows with a null series_id or bin_idx are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytora.operators import stats
from cytora.session import hashed, materialise

#: Bins from which a series is judged in blocks, bins of a block and of its halo, and bins that are worked on together.
WHOLE, BLOCK, HALO, TOGETHER = 8192, 4096, 128, 16_384
#: Deviation from the level on both sides, in scatters, that the shape check asks for; how early the forest has to isolate a reading.
SPIKE_SCATTERS, SUSPECT = 7.0, 0.58
#: Equal consecutive readings from which a run counts as stuck, and bins an excursion has at most.
STUCK_RUN, SPIKE_RUN = 8, 3
#: Forest: trees, rows drawn for each, and their depth; features beyond ``FAR`` scatters are as far as can be.
TREES, DRAWN, DEPTH, FAR = 32, 64, 6, 15.0
#: Bins on each side that make a level, the longest season looked for, and readings that a series has at least.
_AROUND, LONGEST, LEAST = 7, 48, 5
N_FEATURES = 4

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _hash(*keys: np.ndarray | int) -> np.ndarray:
    """Mixed 64-bit numbers of integer keys, element by element."""
    h = np.zeros(1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in keys:
            h = (h ^ np.asarray(k).astype(np.int64).view(np.uint64)) + _MIX[0]
            h = (h ^ (h >> np.uint64(30))) * _MIX[1]
            h = (h ^ (h >> np.uint64(27))) * _MIX[2]
            h = h ^ (h >> np.uint64(31))
    return h


def _uniform(*keys: np.ndarray | int) -> np.ndarray:
    return (_hash(*keys) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


# --- forest ----------------------------------------------------------------------------------------------------


def grow(x: np.ndarray, group: np.ndarray, low: np.ndarray, high: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, rows) of every node of one tree a group, all trees at once; ``low`` and ``high`` are each group's box.

    A node splits the range of its rows at a random place of a random feature (the first one its box, which also holds rows that were not
    drawn), until it holds one row, equal rows or is ``DEPTH`` deep. Node k has the children 2 k + 1 and 2 k + 2.
    """
    groups, total = len(low), 2 ** (DEPTH + 1) - 1
    feature, cut, size = np.zeros((groups, total), dtype=np.int8), np.full((groups, total), np.nan), np.zeros((groups, total), dtype=np.int32)
    key = group * total
    order = np.argsort(key, kind="stable")
    x, key = x[order], key[order]
    for level in range(DEPTH + 1):
        if not len(key):
            break
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[start, len(key)])
        own = key[start]  # the tree and the number of each node that holds rows
        g, node = own // total, own % total
        size[g, node] = count
        if level == DEPTH:
            break
        lo, hi = (low[g], high[g]) if level == 0 else (np.minimum.reduceat(x, start), np.maximum.reduceat(x, start))
        span = hi - lo
        draw = np.stack([_uniform(seed[g], node, j) for j in range(x.shape[1])], axis=1)
        chosen = np.where(span > 0, draw, -1.0).argmax(axis=1)
        at = np.arange(len(own))
        splits = (count > 1) & (span[at, chosen] > 0)
        where = lo[at, chosen] + _uniform(seed[g], node, -1) * span[at, chosen]
        where = np.where(where <= lo[at, chosen], hi[at, chosen], where)  # both sides keep a row
        feature[g, node] = chosen
        cut[g[splits], node[splits]] = where[splits]
        of = np.repeat(at, count)
        live = splits[of]
        x, of = x[live], of[live]
        key = g[of] * total + 2 * node[of] + 1 + (x[np.arange(len(x)), chosen[of]] >= where[of])
        order = np.argsort(key, kind="stable")
        x, key = x[order], key[order]
    return feature, cut, size


def _mean_path(k: np.ndarray) -> np.ndarray:
    return np.where(k > 2, 2 * (np.log(np.maximum(k - 1, 1)) + 0.5772156649) - 2 * (k - 1) / np.maximum(k, 1), np.where(k == 2, 1.0, 0.0))


def score(x: np.ndarray, series: np.ndarray, forest: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Anomaly score in (0, 1) of each row under the trees of its series; 0.5 where nothing was drawn."""
    feature, cut, size = forest
    trees = TREES
    group = series[:, None] * trees + np.arange(trees)
    at, deep = np.zeros(group.shape, dtype=np.int64), np.zeros(group.shape, dtype=np.float32)
    rows = np.arange(len(x))[:, None]
    for _ in range(DEPTH):
        c = cut[group, at]
        inner = ~np.isnan(c)
        if not inner.any():
            break
        at = np.where(inner, 2 * at + 1 + (x[rows, feature[group, at]] >= c), at)
        deep += inner
    path = (deep + _mean_path(size[group, at])).mean(axis=1)
    drawn = size[:, 0].reshape(-1, trees).mean(axis=1)
    usual = _mean_path(drawn)[series]
    return np.where(usual > 0, 2.0 ** (-path / np.maximum(usual, 1e-9)), 0.5)


def isolation_scores(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scores of the rows of one table."""
    n = len(x)
    if n < 3:
        return np.full(n, 0.5)
    return score(x, np.zeros(n, dtype=np.int64), _forest(x, np.zeros(n, dtype=np.int64), np.arange(n), np.array([n]), np.array([seed])))


def drawn(ids: np.ndarray, rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, tree) of the rows that trees are grown on: about ``DRAWN`` a tree, chosen by a hash of series, row and tree."""
    share = DRAWN / np.maximum(n, 1)
    if (share >= 1).all():
        return np.repeat(np.arange(len(ids)), TREES), np.tile(np.arange(TREES), len(ids))
    return np.nonzero(_uniform(ids[:, None], rows[:, None], np.arange(TREES)[None, :]) < share[:, None])


def _forest(x: np.ndarray, series: np.ndarray, rows: np.ndarray, n: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trees of several series at once; ``n`` and ``ids`` hold a number a series."""
    low, high = np.full((len(n), x.shape[1]), np.inf), np.full((len(n), x.shape[1]), -np.inf)
    start = np.flatnonzero(np.r_[True, series[1:] != series[:-1]])
    low[series[start]], high[series[start]] = np.minimum.reduceat(x, start), np.maximum.reduceat(x, start)
    at, tree = drawn(ids[series], rows, n[series])
    seed = _hash(np.repeat(ids, TREES), np.tile(np.arange(TREES), len(ids))).view(np.int64)
    return grow(x[at], series[at] * TREES + tree, np.repeat(low, TREES, axis=0), np.repeat(high, TREES, axis=0), seed)


# --- readings of several series, one after the other -----------------------------------------------------------


class Segments:
    """Where each series begins and how long it is; rows of a series stand together, in order."""

    def __init__(self, of: np.ndarray):
        self.start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, dtype=np.int64)
        self.n = np.diff(np.r_[self.start, len(of)])
        self.index = np.repeat(np.arange(len(self.start)), self.n)
        self.place = np.arange(len(of)) - self.start[self.index]

    def medians(self, v: np.ndarray) -> np.ndarray:
        """Median of each series."""
        s = v[np.lexsort((v, self.index))]
        return (s[self.start + (self.n - 1) // 2] + s[self.start + self.n // 2]) / 2

    def rolling_median(self, v: np.ndarray) -> np.ndarray:
        """Median of the bins around each, mirrored at the ends of the series."""
        n = self.n[self.index][:, None]
        turn = np.maximum(2 * (n - 1), 1)
        k = np.abs(self.place[:, None] + np.arange(-_AROUND, _AROUND + 1)) % turn
        k = np.where(k >= n, turn - k, k)
        return np.partition(v[self.start[self.index][:, None] + np.minimum(k, n - 1)], _AROUND, axis=1)[:, _AROUND]

    def before(self, v: np.ndarray, lag: np.ndarray | int, missing: float) -> np.ndarray:
        """Value ``lag`` rows earlier in the series."""
        inside = self.place >= lag
        return np.where(inside, v[np.maximum(np.arange(len(v)) - lag, 0)], missing)

    def side_medians(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Medians of up to ``_AROUND`` bins before each bin, and from it on; NaN with fewer than two."""
        place, n = self.place[:, None], self.n[self.index][:, None]
        at = np.arange(len(v))[:, None]
        out = []
        for offsets in (np.arange(-_AROUND, 0), np.arange(_AROUND)):
            inside = (place + offsets >= 0) & (place + offsets < n)
            held = np.sort(np.where(inside, v[np.clip(at + offsets, 0, len(v) - 1)], np.inf), axis=1)
            count = inside.sum(axis=1)
            low, high = np.maximum((count - 1) // 2, 0), np.minimum(count // 2, _AROUND - 1)
            rows = np.arange(len(v))
            with np.errstate(invalid="ignore"):
                out.append(np.where(count >= 2, (held[rows, low] + held[rows, high]) / 2, np.nan))
        return out[0], out[1]


def run_lengths(x: np.ndarray, series: np.ndarray | None = None) -> np.ndarray:
    """Length of the run of equal neighbours that each value lies in."""
    if not len(x):
        return np.zeros(0, dtype=np.int64)
    new = x[1:] != x[:-1]
    if series is not None:
        new = new | (series[1:] != series[:-1])
    length = np.diff(np.r_[np.flatnonzero(np.r_[True, new]), len(x)])
    return np.repeat(length, length)


def _clip(z: np.ndarray) -> np.ndarray:
    return np.clip(z, -FAR, FAR)


def lag_sums(z: np.ndarray, part: Segments, own: np.ndarray | None = None) -> np.ndarray:
    """(series, lag): sums of products of each reading with the one so many bins earlier; sums of blocks add up."""
    c = np.clip(z, -5, 5)
    out = np.zeros((len(part.n), LONGEST))
    for k in range(2, LONGEST):
        v = c * part.before(c, k, 0.0)
        out[:, k] = np.bincount(part.index, weights=v if own is None else v * own, minlength=len(part.n))
    return out


def best_lag(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Season of each series: the lag of the largest mean product, 0 for series too short to have one."""
    lags = np.arange(LONGEST)
    mean = np.where((lags >= 2) & (lags < np.minimum(LONGEST, n // 3)[:, None]), sums / np.maximum(n[:, None] - lags, 1), -np.inf)
    best = mean.argmax(axis=1)
    return np.where(np.isfinite(mean[np.arange(len(n)), best]), best, 0)


def features(x: np.ndarray, z: np.ndarray, part: Segments, scatter: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """(level, difference, seasonal, run-length) of each reading, in scatters of its series; ``lag`` holds one a row."""
    step = (x - part.before(x, 1, np.nan)) / scatter
    step = np.where(np.isnan(step), 0.0, step)
    c = np.clip(z, -5, 5)
    season = np.where(lag > 0, z - part.before(c, lag, 0.0), z)
    return np.column_stack([_clip(z), _clip(step), _clip(season), np.minimum(np.log(run_lengths(x, part.index)), 3.0)])


def floor_of(x_median: np.ndarray) -> np.ndarray:
    """Least scatter of a series, from the median size of its readings."""
    return np.maximum(1e-9, 1e-6 * np.abs(x_median))


def excursions(x: np.ndarray, scatter: np.ndarray, part: Segments, suspect: np.ndarray, times: float = SPIKE_SCATTERS) -> np.ndarray:
    """Which suspects leave, alone or with at most two neighbours that are suspects too, the level on both sides of them."""
    n, out = len(x), np.zeros(len(x), dtype=bool)
    if not suspect.any():
        return out
    before, after = part.side_medians(x)
    left_in = part.n[part.index] - part.place  # rows of the series from here on
    at = np.arange(n)
    for length in range(1, SPIKE_RUN + 1):
        begins = np.flatnonzero(suspect & (left_in > length))
        run = x[np.minimum(begins[:, None] + np.arange(length), n - 1)]
        low, high = run.min(axis=1), run.max(axis=1)
        left, right = before[begins], after[np.minimum(at[begins] + length, n - 1)]
        far = times * scatter[begins]
        with np.errstate(invalid="ignore"):
            away = (low - np.maximum(left, right) > far) | (high - np.minimum(left, right) < -far)
        away &= suspect[np.minimum(begins[:, None] + np.arange(length), n - 1)].all(axis=1)
        for k in range(length):
            out[begins[away] + k] = True
    return out


def disordered(t: np.ndarray) -> np.ndarray:
    """Times that are not finite, negative, repeat the time before, or stand outside the longest increasing order."""
    bad = ~np.isfinite(t) | (t < 0)
    bad[1:] |= t[1:] == t[:-1]
    at = np.flatnonzero(~bad)
    if len(at) < 2 or (np.diff(t[at]) > 0).all():
        return bad
    tails: list[float] = []
    tail_at: list[int] = []
    before = np.full(len(at), -1)
    for k, i in enumerate(at):
        j = int(np.searchsorted(tails, t[i]))
        before[k] = tail_at[j - 1] if j else -1
        if j == len(tails):
            tails.append(t[i])
            tail_at.append(k)
        elif t[i] < tails[j]:  # of equal times the first stays
            tails[j], tail_at[j] = t[i], k
    keep = np.zeros(len(at), dtype=bool)
    k = tail_at[-1]
    while k >= 0:
        keep[k] = True
        k = before[k]
    bad[at[~keep]] = True
    return bad


# --- judging ---------------------------------------------------------------------------------------------------


class Context:
    """What blocks of a long series are judged by: scatter, season and trees of the whole."""

    def __init__(self, scatter: float, lag: int, forest: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.scatter, self.lag, self.forest = scatter, lag, forest


def usable(raw: np.ndarray, has_raw: np.ndarray, maximum: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(readings beyond a physical limit, readings that levels are formed of)."""
    with np.errstate(invalid="ignore"):
        limit = has_raw & (~np.isfinite(raw) | (raw <= 0) | (np.isfinite(maximum) & (raw > maximum)))
    return limit, has_raw & ~limit


def judge_all(series: np.ndarray, bins: np.ndarray, raw: np.ndarray, time: np.ndarray, has_raw: np.ndarray, has_time: np.ndarray, maximum: np.ndarray, context: Context | None = None) -> dict[str, np.ndarray]:
    """Flags and forest score of each bin of the series given, sorted by series and bin; with ``context``, of one block of a series."""
    n = len(raw)
    limit, good_ = usable(raw, has_raw, maximum)
    clock, stuck, spike, scores = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool), np.zeros(n, dtype=bool), np.full(n, np.nan)
    whole = Segments(series)
    timed = np.flatnonzero(has_time)
    if len(timed):
        t, s = time[timed], Segments(series[timed])
        with np.errstate(invalid="ignore"):
            wrong = ~np.isfinite(t) | (t < 0) | ((s.place > 0) & ~(np.diff(t, prepend=-np.inf) > 0))
        for k in np.flatnonzero(np.bincount(s.index, weights=wrong, minlength=len(s.n)) > 0):
            part = slice(s.start[k], s.start[k] + s.n[k])
            clock[timed[part]] = disordered(t[part])
    present = np.flatnonzero(has_raw)
    stuck[present] = (run_lengths(raw[present], whole.index[present]) >= STUCK_RUN) & np.isfinite(raw[present])
    good = np.flatnonzero(good_)
    good = good[np.bincount(whole.index[good], minlength=len(whole.n))[whole.index[good]] >= LEAST] if context is None else good
    if len(good):
        x, part = raw[good], Segments(series[good])
        rest = x - part.rolling_median(x)
        if context is None:
            middle = part.medians(rest)
            per = np.maximum(1.4826 * part.medians(np.abs(rest - middle[part.index])), floor_of(part.medians(np.abs(x))))
            lag = best_lag(lag_sums(rest / per[part.index], part), part.n)
            scatter = per[part.index]
            f = features(x, rest / scatter, part, scatter, lag[part.index])
            forest = _forest(f, part.index, bins[good], part.n, series[good][part.start])
            scores[good] = score(f, part.index, forest)
        else:
            scatter = np.full(len(x), context.scatter)
            f = features(x, rest / scatter, part, scatter, np.full(len(x), context.lag))
            scores[good] = score(f, part.index, context.forest)
        spike[good] = excursions(x, scatter, part, scores[good] >= SUSPECT)
    return {"limit": limit, "stuck": stuck, "spike": spike, "clock": clock, "score": scores}


def judge(raw: np.ndarray, time: np.ndarray, has_raw: np.ndarray, has_time: np.ndarray, maximum: float, seed: int = 0) -> dict[str, np.ndarray]:
    """Flags and forest score of each bin of one series, bins in order."""
    n = len(raw)
    return judge_all(np.full(n, seed, dtype=np.int64), np.arange(n), raw, time, has_raw, has_time, np.full(n, maximum, dtype=float))


_SCHEMA = "series_id long, bin_idx int, score double, is_limit boolean, is_stuck boolean, is_spike boolean, is_clock boolean"
_NAMES = ["series_id", "bin_idx", "score", "is_limit", "is_stuck", "is_spike", "is_clock"]
_INPUT = ["series_id", "bin_idx", "raw_median", "bin_time", "maximum"]


def _columns(table: pa.Table) -> dict[str, np.ndarray]:
    """Arrays of a sorted table without repeated bins; nulls become flags."""
    series, bins = table.column("series_id").to_numpy(), table.column("bin_idx").to_numpy()
    first = np.r_[True, (series[1:] != series[:-1]) | (bins[1:] != bins[:-1])][: len(series)]
    number = lambda c: table.column(c).to_numpy()[first].astype(float)
    there = lambda c: table.column(c).is_valid().to_numpy()[first]
    return {"series": series[first], "bins": bins[first], "raw": number("raw_median"), "time": number("bin_time"), "has_raw": there("raw_median"), "has_time": there("bin_time"), "maximum": number("maximum")}


def _judged(c: dict[str, np.ndarray], own: np.ndarray | None = None, context: Context | None = None) -> pa.RecordBatch:
    found = judge_all(**c, context=context)
    own = np.ones(len(c["series"]), dtype=bool) if own is None else own
    arrays = [c["series"][own], c["bins"][own].astype(np.int32), found["score"][own], found["limit"][own], found["stuck"][own], found["spike"][own], found["clock"][own]]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=_NAMES)


def _many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judges the series of a sorted partition, as many together as ``TOGETHER`` bins hold; the last one of a batch may go on in the next."""
    held: list[pa.RecordBatch] = []

    def pieces(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        series = table.column("series_id").to_numpy()
        starts = np.r_[np.flatnonzero(np.r_[True, series[1:] != series[:-1]]), len(series)] if len(series) else np.zeros(1, dtype=np.int64)
        done = 0
        upto = len(series) if last else int(starts[-2]) if len(starts) > 1 else 0
        while done < upto:
            end = int(starts[max(np.searchsorted(starts, done + TOGETHER, "right") - 1, np.searchsorted(starts, done, "right"))])
            end = min(end, upto)
            yield _judged(_columns(table.slice(done, end - done)))
            done = end
        held = table.slice(upto).to_batches()

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TOGETHER:
            yield from pieces(pa.Table.from_batches(held), False)
    if held:
        yield from pieces(pa.Table.from_batches(held), True)


def channel_limits(samples: DataFrame, channels: DataFrame) -> DataFrame:
    """(sample_id, channel_name, maximum): the largest value each channel of a sample can read."""
    own = samples.select("sample_id", "group_id").filter("sample_id IS NOT NULL AND group_id IS NOT NULL").distinct()
    top = channels.filter("maximum IS NOT NULL AND NOT isnan(maximum)").groupBy("group_id", "channel_name").agg(F.max("maximum").cast("double").alias("maximum"))
    return own.join(top, "group_id").groupBy("sample_id", "channel_name").agg(F.max("maximum").alias("maximum"))


def judge_series(series: DataFrame, limits: DataFrame, whole: int = WHOLE, block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """Forest score and flags of every bin: (series_id, bin_idx, score, is_limit, is_stuck, is_spike, is_clock)."""
    bins = series.select(F.col("series_id").cast("long").alias("series_id"), F.col("bin_idx").cast("int").alias("bin_idx"), "sample_id", "channel_name", F.col("raw_median").cast("double").alias("raw_median"), F.col("bin_time").cast("double").alias("bin_time"))
    bins = bins.filter("series_id IS NOT NULL AND bin_idx IS NOT NULL").join(limits.select("sample_id", "channel_name", "maximum"), ["sample_id", "channel_name"], "left").select(*_INPUT)
    spark = series.sparkSession
    sizes = series.filter("series_id IS NOT NULL AND bin_idx IS NOT NULL").groupBy(F.col("series_id").cast("long").alias("series_id")).agg(F.count(F.lit(1)).alias("n"))
    long = materialise(sizes.filter(F.col("n") > whole).select("series_id"))  # one row for every ``whole`` bins at most
    many = not long.isEmpty()
    short = bins.join(long, "series_id", "left_anti") if many else bins
    judged = hashed(short, "series_id").sortWithinPartitions("series_id", "bin_idx", "raw_median", "bin_time").mapInArrow(_many, _SCHEMA)
    return judged.unionByName(_long_series(spark, bins.join(long, "series_id"), block, halo)) if many else judged


def _long_series(spark, bins: DataFrame, block: int, halo: int) -> DataFrame:
    """The same for series of any length: blocks with ``halo`` bins on both sides, judged by what holds for the whole series."""
    once = bins.groupBy("series_id", "bin_idx").agg(*[F.min_by(c, F.struct(F.col("raw_median").isNull(), "raw_median", F.col("bin_time").isNull(), "bin_time")).alias(c) for c in _INPUT[2:]])
    at = F.floor(F.col("bin_idx") / block).cast("int")
    around = F.array_distinct(F.array(at, F.floor((F.col("bin_idx") - halo) / block).cast("int"), F.floor((F.col("bin_idx") + halo) / block).cast("int")))
    rows = materialise(once.withColumn("own", at).withColumn("block", F.explode(around)))
    schema = "series_id long, block int, bin_idx int, x double, rest double"

    def table_of(table: pa.Table, key: tuple) -> tuple[dict[str, np.ndarray], np.ndarray]:
        table = table.sort_by("bin_idx")
        return _columns(table), table.column("own").to_numpy() == key[1].as_py()

    def rests(key: tuple, table: pa.Table) -> pa.Table:
        c, own = table_of(table, key)
        good = usable(c["raw"], c["has_raw"], c["maximum"])[1]
        x = c["raw"][good]
        rest = x - Segments(c["series"][good]).rolling_median(x) if len(x) else x
        o = own[good]
        return pa.table({"series_id": c["series"][good][o], "block": pa.array(np.full(int(o.sum()), key[1].as_py(), dtype=np.int32)), "bin_idx": c["bins"][good][o].astype(np.int32), "x": x[o], "rest": rest[o]})

    by_block = lambda df: hashed(df, "series_id", "block").groupBy("series_id", "block")
    rest = materialise(by_block(rows).applyInArrow(rests, schema))
    size = stats.exact_quantiles(rest.select("series_id", F.abs("x").alias("s")), ["series_id"], ["s"], [0.5]).select("series_id", F.col("q")[0].alias("size"), F.col("n").alias("n"))
    per = stats.scaled_mad(rest, "series_id", "rest").join(size, "series_id")
    scatter = materialise(per.select("series_id", "n", F.greatest("mad", F.lit(1e-9), 1e-6 * F.col("size")).alias("scatter")))
    blocks = materialise(rows.select("series_id", "block").distinct())

    def with_context(df: DataFrame, context: DataFrame, f, out: str) -> DataFrame:
        side = blocks.join(context, "series_id")
        return hashed(df, "series_id", "block").groupBy("series_id", "block").cogroup(hashed(side, "series_id", "block").groupBy("series_id", "block")).applyInArrow(f, out)

    def lags(key: tuple, table: pa.Table, context: pa.Table) -> pa.Table:
        c, own = table_of(table, key) if table.num_rows else (None, None)
        if c is None or not context.num_rows:
            return pa.table({"series_id": pa.array([], pa.int64()), "sums": pa.array([], pa.list_(pa.float64()))})
        good = usable(c["raw"], c["has_raw"], c["maximum"])[1]
        x, part = c["raw"][good], Segments(c["series"][good])
        z = (x - part.rolling_median(x)) / context.column("scatter")[0].as_py() if len(x) else x
        sums = lag_sums(z, part, own[good].astype(float)) if len(x) else np.zeros((1, LONGEST))
        return pa.table({"series_id": pa.array([key[0].as_py()], pa.int64()), "sums": pa.array([sums[0].tolist()], pa.list_(pa.float64()))})

    each = with_context(rows, scatter, lags, "series_id long, sums array<double>").select("series_id", F.posexplode("sums").alias("lag", "s"))
    total = each.groupBy("series_id", "lag").agg(F.sum("s").alias("s"))
    listed = total.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("lag", "s"))).alias("l")).join(scatter, "series_id")
    mean = F.transform("l", lambda v: F.when((v["lag"] >= 2) & (v["lag"] < F.least(F.lit(LONGEST), F.floor(F.col("n") / 3))), F.struct((v["s"] / (F.col("n") - v["lag"])).alias("m"), (-v["lag"]).alias("k"))))
    seasons = materialise(listed.select("series_id", "n", "scatter", F.coalesce(-F.array_max(mean)["k"], F.lit(0)).cast("int").alias("lag")))

    def block_features(key: tuple, table: pa.Table, context: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(features, bins) of the readings of a block's own bins."""
        c, own = table_of(table, key)
        good = usable(c["raw"], c["has_raw"], c["maximum"])[1]
        x, part = c["raw"][good], Segments(c["series"][good])
        if not len(x):
            return np.zeros((0, N_FEATURES)), np.zeros(0, dtype=np.int64)
        scatter_ = np.full(len(x), context.column("scatter")[0].as_py())
        z = (x - part.rolling_median(x)) / scatter_
        f = features(x, z, part, scatter_, np.full(len(x), context.column("lag")[0].as_py()))
        return f[own[good]], c["bins"][good][own[good]]

    def draw(key: tuple, table: pa.Table, context: pa.Table) -> pa.Table:
        empty = pa.table({"series_id": pa.array([], pa.int64()), "tree": pa.array([], pa.int32()), "f": pa.array([], pa.list_(pa.float64()))})
        if not table.num_rows or not context.num_rows:
            return empty
        f, at_bin = block_features(key, table, context)
        if not len(f):
            return empty
        n = np.full(len(f), context.column("n")[0].as_py())
        row, tree = drawn(np.full(len(f), key[0].as_py()), at_bin, n)
        box = np.stack([f.min(axis=0), f.max(axis=0)])  # trees -1 and -2 stand for the range
        values = np.concatenate([f[row], box])
        trees = np.concatenate([tree, [-1, -2]])
        return pa.table({"series_id": pa.array(np.full(len(trees), key[0].as_py()), pa.int64()), "tree": pa.array(trees.astype(np.int32)), "f": pa.array(values.tolist(), pa.list_(pa.float64()))})

    picked = with_context(rows, seasons, draw, "series_id long, tree int, f array<double>")

    def plant(key: tuple, table: pa.Table) -> pa.Table:
        """Trees of a series from what its blocks have drawn: about ``TREES`` times ``DRAWN`` rows and two for every block."""
        f, tree = np.array(table.column("f").to_pylist()), table.column("tree").to_numpy()
        low, high = f[tree == -1].min(axis=0), f[tree == -2].max(axis=0)
        use = tree >= 0
        seed = _hash(np.full(TREES, key[0].as_py()), np.arange(TREES)).view(np.int64)
        feature, cut, rows_ = grow(f[use], tree[use].astype(np.int64), np.tile(low, (TREES, 1)), np.tile(high, (TREES, 1)), seed)
        return pa.table({"series_id": pa.array([key[0].as_py()], pa.int64()), "feature": [feature.tobytes()], "cut": [cut.tobytes()], "size": [rows_.tobytes()]})

    forests = hashed(picked, "series_id").groupBy("series_id").applyInArrow(plant, "series_id long, feature binary, cut binary, size binary")
    ready = materialise(seasons.join(forests, "series_id"))

    def last(key: tuple, table: pa.Table, context: pa.Table) -> pa.Table:
        c, own = table_of(table, key) if table.num_rows else (None, None)
        if c is None:
            return pa.Table.from_batches([], schema=_ARROW)
        known = None
        if context.num_rows:
            shape = (TREES, -1)
            get = lambda n, t: np.frombuffer(context.column(n)[0].as_py(), dtype=t).reshape(shape)
            known = Context(context.column("scatter")[0].as_py(), context.column("lag")[0].as_py(), (get("feature", np.int8), get("cut", np.float64), get("size", np.int32)))
        return pa.Table.from_batches([_judged(c, own, known)]).cast(_ARROW)

    side = blocks.join(ready, "series_id")
    return hashed(rows, "series_id", "block").groupBy("series_id", "block").cogroup(hashed(side, "series_id", "block").groupBy("series_id", "block")).applyInArrow(last, _SCHEMA)


_ARROW = pa.schema([("series_id", pa.int64()), ("bin_idx", pa.int32()), ("score", pa.float64()), *[(n, pa.bool_()) for n in _NAMES[3:]]])


def implausible_bins(series: DataFrame, samples: DataFrame, channels: DataFrame) -> DataFrame:
    """Distinct (series_id, bin_idx) of the bins that the forest or a rule finds implausible."""
    judged = judge_series(series, channel_limits(samples, channels))
    return judged.filter("is_limit OR is_stuck OR is_spike OR is_clock").select("series_id", "bin_idx")
