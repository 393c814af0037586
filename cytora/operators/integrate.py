"""Batch integration: the channels of every batch bent so that their quantiles meet a goal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytora.operators import stats
from cytora.operators.fits import splines
from cytora.session import materialise

# Events a batch has at least to be integrated, and the quantiles compared.
LEAST_EVENTS = 50
HUNDREDTHS = [i / 100 for i in range(1, 100)]


def batch_quantiles(rows: DataFrame, batch: str, channels: list[str], probabilities: list[float], cluster: str | None = None) -> DataFrame:
    """(batch, cluster?, channel, n, q): quantiles of every channel of every batch, or of every cluster of it, of at least 50 events."""
    keys = [batch] + ([cluster] if cluster else [])
    size = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") >= LEAST_EVENTS)
    q = stats.exact_quantiles(rows, keys, channels, probabilities)
    return q.join(size, keys, "left_semi")


def goal_quantiles(quantiles: DataFrame, goal: str = "mean", batch: str = "batch", label: object = None, cluster: str | None = None) -> DataFrame:
    """(cluster?, channel, goal): the quantiles to meet: ``mean`` or ``median`` over batches, or those of the batch ``label``."""
    keys = ([cluster] if cluster else []) + ["channel"]
    if goal == "batch":
        return quantiles.filter(F.col(batch) == label).select(*keys, F.col("q").alias("goal"))
    if goal not in ("mean", "median"):
        raise ValueError(f"unknown goal {goal}")
    each = quantiles.select(*keys, F.posexplode("q").alias("_p", "_q"))
    over = each.groupBy(*keys, "_p").agg(F.avg("_q").alias("_g")) if goal == "mean" else _medians(each, keys)
    listed = over.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_p", "_g"))).alias("_l"))
    return listed.select(*keys, F.transform("_l", lambda s: s["_g"]).alias("goal"))


def _medians(each: DataFrame, keys: list[str]) -> DataFrame:
    renamed = each.withColumnRenamed("channel", "_channel")
    own = ["_channel" if k == "channel" else k for k in keys]
    q = stats.exact_quantiles(renamed, [*own, "_p"], ["_q"], [0.5]).select(*own, "_p", F.col("q")[0].alias("_g"))
    return q.withColumnRenamed("_channel", "channel")


_KNOTS = "batch_ string, channel_ string, x array<double>, k array<struct<x:double,y:double,m:double>>"


def batch_splines(quantiles: DataFrame, goal: DataFrame, batch: str, most: int) -> DataFrame:
    """(batch_, channel_, x, k): knots of the cubic that takes each batch's quantiles to the goal, null where there is nothing to bend."""
    pairs = quantiles.join(goal, "channel").select(F.col(batch).cast("string").alias("batch_"), F.col("channel").alias("channel_"), "q", "goal")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [splines.knots(np.asarray(a, float), np.asarray(b, float)) for a, b in zip(pdf["q"], pdf["goal"])]
            structs = [[{"x": x, "y": y, "m": m} for x, y, m in zip(*f)] if len(f[0]) else None for f in found]
            yield pd.DataFrame({"batch_": pdf["batch_"], "channel_": pdf["channel_"], "x": [splines.padded(f[0], most) if len(f[0]) else None for f in found], "k": structs})

    return pairs.mapInPandas(fit, _KNOTS)


def integrated(rows: DataFrame, batch: str, channels: list[str], probabilities: list[float] = HUNDREDTHS, goal: str = "mean", label: object = None) -> DataFrame:
    """``rows`` with the channels bent batch by batch, single precision, other columns kept.

    Knots are arrays on a row a batch, joined to the events (shared with all tasks only if Spark finds them small) and evaluated by
    expressions. Batches of fewer than 50 events, single batches, null batches, NaN and null values stay as they are.
    """
    q = batch_quantiles(rows, batch, channels, probabilities)
    q = materialise(q)  # read by the goal and by the splines
    most = len(probabilities)
    per = materialise(batch_splines(q, goal_quantiles(q, goal, batch, label), batch, most))
    several = per.select("batch_").distinct().agg((F.count(F.lit(1)) > 1).alias("_several"))
    per = per.join(F.broadcast(several)).filter("_several")  # one row
    out = rows
    for c in channels:
        own = per.filter(F.col("channel_") == c).select("batch_", F.col("x").alias("_x"), F.col("k").alias("_k"))
        joined = out.join(own, F.col(batch).cast("string") == F.col("batch_"), "left")
        # one channel a piece of generated code: that of several is too long for the JVM to compile; no rows move here
        out = splines.bent(joined, {c: ("_x", "_k")}, most).select(*rows.columns).withColumn(c, F.col(c).cast("float")).coalesce(_AS_MANY)
    return out


#: More partitions than any input has, so that nothing is put together.
_AS_MANY = 1 << 24
