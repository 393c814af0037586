"""Histograms and density grids: the bin rules differ in their edges, everything else is one aggregation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fit_bin(x: Column, low: float, high: float, bins: int) -> Column:
    """Bin of a model histogram: right edge excluded, null outside."""
    at = F.floor((x - low) / (high - low) * bins)
    return F.when(~F.isnan(x) & (at >= 0) & (at < bins), at).cast("int")


def plot_bin(norm: Column, bins: int) -> Column:
    """Bin of a plot: both ends of [0, 1] included."""
    return F.when(~F.isnan(norm) & norm.between(0, 1), F.floor(norm * (bins - 1))).cast("int")


def display_bin(norm: Column, bins: int) -> Column:
    """Bin of a display histogram: the right edge falls into the last bin."""
    return F.when(~F.isnan(norm) & norm.between(0, 1), F.least(F.floor(norm * bins), F.lit(bins - 1))).cast("int")


def counted(df: DataFrame, keys: list[str], bin_: Column, out: str = "bin") -> DataFrame:
    return df.select(*keys, bin_.alias(out)).filter(f"{out} IS NOT NULL").groupBy(*keys, out).agg(F.count(F.lit(1)).alias("n"))


def dense(hist: DataFrame, keys: list[str], bins: int, out: str = "bin") -> DataFrame:
    """Adds the empty bins of every group; a group has ``bins`` rows, made by a generator, not by a join."""
    groups = hist.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(out, "n"))).alias("_m")) if keys else hist.agg(F.map_from_entries(F.collect_list(F.struct(out, "n"))).alias("_m"))
    rows = groups.select(*keys, "_m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias(out))
    return rows.select(*keys, out, F.coalesce(F.try_element_at("_m", F.col(out)), F.lit(0).cast("long")).alias("n"))


def shares(hist: DataFrame, keys: list[str]) -> DataFrame:
    return hist.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def moving_average(hist: DataFrame, keys: list[str], order: str, value: str, half: int) -> DataFrame:
    """Centred mean over ``2 half + 1`` rows, shorter at the ends."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)
    return hist.withColumn("smooth", F.avg(value).over(w))


def smooth_121(values: np.ndarray, passes: int) -> np.ndarray:
    """Repeated [1, 2, 1] smoothing; weights beyond an end are left out."""
    v = np.asarray(values, dtype=float)
    for _ in range(passes if len(v) > 1 else 0):
        total, weight = 2 * v, np.full(len(v), 2.0)
        total[1:] += v[:-1]
        weight[1:] += 1
        total[:-1] += v[1:]
        weight[:-1] += 1
        v = total / weight
    return v


def blur(grid: np.ndarray, passes: int) -> np.ndarray:
    """Separable binomial blur with five taps; weights beyond a border are left out."""
    taps = np.array([1.0, 4.0, 6.0, 4.0, 1.0])
    g = np.asarray(grid, dtype=float)
    for _ in range(passes):
        for axis in (0, 1):
            along = lambda a: np.apply_along_axis(np.convolve, axis, a, taps, "same")
            g = along(g) / along(np.ones_like(g))
    return g


def smoothed_grid(grid: DataFrame, keys: list[str], size: int, passes: int) -> DataFrame:
    """Blurred density of each group; a group is one grid of ``size`` x ``size``, whatever its number of events."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros((size, size))
        g[pdf["ybin"].to_numpy(), pdf["xbin"].to_numpy()] = pdf["n"].to_numpy()
        b = blur(g, passes)
        y, x = np.nonzero(b > 1e-12)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(x) for k in keys}, "xbin": x, "ybin": y, "density": b[y, x]})

    schema = ", ".join([f"{k} string" for k in keys] + ["xbin int", "ybin int", "density double"])
    return grid.groupBy(*keys).applyInPandas(run, schema)


def contours(grid: np.ndarray, count: int) -> list[tuple[float, list[tuple[float, float, float, float]]]]:
    """Level lines of a density grid: (level, segments x1 y1 x2 y2), by linear interpolation on the cell borders."""
    top = float(np.max(grid)) if grid.size else 0.0
    out = []
    for i in range(max(2, min(80, count))):
        level = (0.08 + 0.88 * (i + 1) / (count + 1)) * top
        segments = []
        for y in range(grid.shape[0] - 1):
            for x in range(grid.shape[1] - 1):
                corner = [(x, y, grid[y, x]), (x + 1, y, grid[y, x + 1]), (x + 1, y + 1, grid[y + 1, x + 1]), (x, y + 1, grid[y + 1, x])]
                cut = []
                for (ax, ay, a), (bx, by, b) in zip(corner, corner[1:] + corner[:1]):
                    if (a >= level) != (b >= level):
                        t = (level - a) / (b - a)
                        cut.append((ax + t * (bx - ax), ay + t * (by - ay)))
                segments.extend((*cut[k], *cut[k + 1]) for k in range(0, len(cut) - 1, 2))
        out.append((level, segments))
    return out
