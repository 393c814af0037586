"""Statistics of populations: finite values only, and 0 for an empty population."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytora.functions.exprs import fin


def kept(c: Column, mask: Column | None = None) -> Column:
    """The value where it is finite and within the population."""
    ok = fin(c) if mask is None else fin(c) & mask
    return F.when(ok, c.cast("double"))


def mean(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def median(c: Column) -> Column:
    return F.coalesce(F.percentile(c, F.lit(0.5)), F.lit(0.0))


def geometric_mean(c: Column) -> Column:
    return F.coalesce(F.exp(F.avg(F.ln(F.when(c > 0, c)))), F.lit(0.0))


def deviation(c: Column) -> Column:
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def variation(c: Column) -> Column:
    """Percent; negative where the mean is."""
    return F.when(mean(c) == 0, 0.0).otherwise(100.0 * deviation(c) / mean(c))


NATIVE: dict[str, Callable[[Column], Column]] = {
    "Mean": mean, "Median": median, "GeometricMean": geometric_mean, "StandardDeviation": deviation, "CV": variation,
}


def quantiles(c: Column, probabilities: list[float]) -> Column:
    """Linearly interpolated quantiles of the finite values, as one aggregate for all probabilities."""
    if any(not 0 <= p <= 1 for p in probabilities):
        raise ValueError("a probability lies outside [0, 1]")
    return F.percentile(kept(c), F.array(*[F.lit(float(p)) for p in probabilities]))


#: Buckets per unit of the natural logarithm in the first pass of exact quantiles, and their number for the zero bucket's sake.
RESOLUTION, MIDDLE = 256, 1 << 20


def _bucket(v: Column) -> Column:
    """A number that never falls as the value grows: the rounded logarithm of its size, with its sign."""
    size = F.floor(F.ln(F.abs(v)) * RESOLUTION) + MIDDLE
    return F.when(v == 0, 0).when(v > 0, size).otherwise(-size).cast("int")


def _same(a: str, b: str, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return on


def exact_quantiles(df: DataFrame, keys: list[str], values: list[str], probabilities: list[float], weight: str | None = None) -> DataFrame:
    """(keys..., channel, n, q): linearly interpolated quantiles of the finite values of each column, exact for groups of any size.

    Values are counted in logarithmic buckets first; a rank lies in one bucket, and only the values of such buckets are counted one by one.
    No task holds the values of a group: ordered are the buckets of a group (some thousand) and the distinct values of a bucket.
    ``weight`` counts a row several times. Columns without a finite value have no row; null keys are a group of their own.
    """
    if any(not 0 <= p <= 1 for p in probabilities):
        raise ValueError("a probability lies outside [0, 1]")
    own = [f"_k{i}" for i in range(len(keys))]
    every = [*own, "_c"]
    times = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    named = [F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in values]
    rows = df.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], times.alias("_w"), F.inline(F.array(*named)) if len(values) > 1 else F.col(values[0]).cast("double").alias("_v"))
    if len(values) == 1:
        rows = rows.withColumn("_c", F.lit(values[0]))
    rows = rows.filter(fin(F.col("_v"))).select(*every, "_w", F.when(F.col("_v") == 0, 0.0).otherwise(F.col("_v")).alias("_v")).withColumn("_b", _bucket(F.col("_v")))
    counted = rows.groupBy(*every, "_b").agg(F.sum("_w").alias("_w"))
    upto = F.sum("_w").over(Window.partitionBy(*every).orderBy("_b"))
    total = F.sum("_w").over(Window.partitionBy(*every))
    placed = counted.select(*every, "_b", (upto - F.col("_w")).alias("_from"), upto.alias("_to"), total.alias("_n"))
    positions = F.array(*[F.lit(float(p)) for p in probabilities])
    at = lambda n: F.transform(positions, lambda p: p * (n - 1))
    ranks = F.array_distinct(F.flatten(F.transform(at(F.col("_n")), lambda h: F.array(F.floor(h), F.ceil(h)))))
    chosen = placed.withColumn("_need", F.filter(ranks, lambda r: (r >= F.col("_from")) & (r < F.col("_to")))).filter(F.size("_need") > 0)
    home = [*every, "_b"]
    single = rows.alias("r").join(chosen.alias("s"), _same("r", "s", home), "left_semi")
    distinct = single.groupBy(*home, "_v").agg(F.sum("_w").alias("_w"))
    inside = F.sum("_w").over(Window.partitionBy(*home).orderBy("_v"))
    ranked = distinct.withColumn("_hi", inside).alias("r").join(chosen.alias("s"), _same("r", "s", home))
    ranked = ranked.select(*[F.col(f"r.{c}").alias(c) for c in [*every, "_v"]], "_n", "_need", (F.col("_from") + F.col("_hi") - F.col("_w")).alias("_lo"), (F.col("_from") + F.col("_hi")).alias("_hi"))
    needed = ranked.filter(F.exists("_need", lambda r: (r >= F.col("_lo")) & (r < F.col("_hi")))).drop("_need")
    listed = needed.groupBy(*every, "_n").agg(F.collect_list(F.struct("_lo", "_hi", "_v")).alias("_l"))  # at most two for each probability
    value = lambda r: F.filter("_l", lambda s: (s["_lo"] <= r) & (r < s["_hi"]))[0]["_v"]
    between = lambda h: (1 - (h - F.floor(h))) * value(F.floor(h)) + (h - F.floor(h)) * value(F.ceil(h))
    return listed.select(*[F.col(o).alias(k) for k, o in zip(keys, own)], F.col("_c").alias("channel"), F.col("_n").alias("n"), F.transform(at(F.col("_n")), between).alias("q"))


def exact_medians(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys..., values...): exact medians of several columns, one row a group; null for a column without finite values."""
    q = exact_quantiles(df, keys, values, [0.5])
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("channel") == c, F.col("q")[0])).alias(c) for c in values])


def scaled_mad(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, mad): 1.4826 times the median distance from the median."""
    middle = exact_medians(df, [group], [value]).withColumnRenamed(value, "_m").withColumnRenamed(group, "_mg")
    away = df.join(middle, F.col(group).eqNullSafe(F.col("_mg"))).select(group, F.abs(F.col(value) - F.col("_m")).alias("_d"))
    return exact_quantiles(away, [group], ["_d"], [0.5]).select(group, (1.4826 * F.col("q")[0]).alias("mad"))


def robust_maximum(df: DataFrame, group: str, value: str, skip: int = 50) -> DataFrame:
    """(group, robust_max): the largest value after leaving out the ``skip`` largest, or the largest of few."""
    w = Window.partitionBy(group).orderBy(F.col(value).desc())
    top = df.filter(fin(F.col(value))).select(group, value).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= skip + 1)
    return top.groupBy(group).agg(F.coalesce(F.max(F.when(F.col("_r") == skip + 1, F.col(value))), F.max(value)).alias("robust_max"))


def python_statistic(df: DataFrame, group: str, channels: list[str], entry: Callable[[np.ndarray, list[str], dict], float], parameters: dict | None = None) -> DataFrame:
    """(group, value): a user's function over the matrix of each group; a failure gives NaN."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            value = float(entry(pdf[channels].to_numpy(np.float32), channels, parameters or {}))
        except Exception:  # noqa: BLE001  a statistic must not end the job
            value = float("nan")
        return pd.DataFrame({group: [pdf[group].iloc[0]], "value": [value]})

    rows = df.select(group, *channels).groupBy(group).applyInPandas(run, f"{group} string, value double")
    return rows.withColumn("value", F.coalesce("value", F.lit(float("nan"))))  # NaN turns into null on the way


def implied_axis(low: Column, high: Column, kind: str, cap: float | None = None) -> tuple[Column, Column]:
    """Axis range, to the hundred, that the extremes of a channel's data imply; ``cap`` is the channel's maximum."""
    down, up = lambda v: F.floor(v / 100) * 100.0, lambda v: F.ceil(v / 100) * 100.0
    lift = lambda v: v if cap is None else F.greatest(v, F.lit(-0.01 * cap))
    trim = lambda v: v if cap is None else F.least(v, F.lit(float(cap)))
    if kind == "time":
        start = lift(down(low))
        return start, trim(F.when(high > low, up(high)).otherwise(start + 1e-6))
    top = F.greatest(high, F.lit(1e-6))
    under, over = (0.1, 1.1) if kind == "linear" else (0.01, 3.0)
    return F.greatest(lift(down(-under * top)), down(low)), trim(up(over * top))
