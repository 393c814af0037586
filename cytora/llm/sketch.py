"""Percentiles of very large numeric columns from mergeable sketches.

A value falls into a signed logarithmic bucket of fixed relative width: bucket ``k`` of a sign holds the
magnitudes in ``(g^(k-1), g^k]`` with ``g = (1 + accuracy) / (1 - accuracy)``. A sketch is the count of each
bucket. Sketches of partitions, days or files are combined by adding counts of equal buckets, and a percentile is
read from the running count; its value is off by at most the share ``accuracy`` of the true one.

Everything is a plain aggregation: partial counts are made before the shuffle, and a hot group is spread by its
buckets and parts, never gathered as values.

Defined results: null and non-finite values are not counted; zero is a bucket of its own; a group without
counted values gives no row. Percentile ``p`` is the value of rank ``floor(p * (n - 1))``, counted from 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytora.session import materialise

#: Guaranteed relative error of a percentile, and the percentiles that are reported.
ACCURACY = 0.01
PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
#: Magnitudes below this one count as zero.
TINY = 1e-30


def _log_growth(accuracy: float) -> float:
    return math.log((1 + accuracy) / (1 - accuracy))


def bucket(value: Column, accuracy: float = ACCURACY) -> Column:
    """Signed bucket number, ordered as the values are; null for null and non-finite values.

    Positive bucket ``k`` is stored as ``k + 2^20``, a negative one as ``-(k + 2^20)``, zero as 0.
    """
    x = value.cast("double")
    k = F.ceil(F.ln(F.abs(x)) / F.lit(_log_growth(accuracy))).cast("int") + F.lit(1 << 20)
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.when(finite, F.when(F.abs(x) < TINY, F.lit(0)).when(x > 0, k).otherwise(-k))


def bucket_value(number: Column, accuracy: float = ACCURACY) -> Column:
    """The value that stands for a bucket: the point with equal relative distance from both ends."""
    k = (F.abs(number) - F.lit(1 << 20)).cast("double")
    middle = F.exp(k * F.lit(_log_growth(accuracy))) * F.lit(2 / ((1 + accuracy) / (1 - accuracy) + 1))
    return F.when(number == 0, F.lit(0.0)).when(number > 0, middle).otherwise(-middle)


def sketch(values: DataFrame, keys: list[str], value: str, accuracy: float = ACCURACY) -> DataFrame:
    """(keys, bucket, n): the sketch of ``value`` for each group of ``keys``."""
    rows = values.select(*keys, bucket(F.col(value), accuracy).alias("bucket")).filter("bucket IS NOT NULL")
    return rows.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Combines sketches: counts of equal buckets of the groups ``keys`` add up."""
    return sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, keys: list[str], probabilities: tuple[float, ...] = PERCENTILES, accuracy: float = ACCURACY) -> DataFrame:
    """(keys, n_values, p, bucket, estimate) read from merged sketches; as many rows as probabilities for each group.

    The window of a group holds its buckets, some thousands at most whatever the number of values.
    """
    w = Window.partitionBy(*keys).orderBy("bucket")
    running = sketches.withColumn("_upto", F.sum("n").over(w)).withColumn("_all", F.sum("n").over(Window.partitionBy(*keys)))
    ranks = F.array(*[F.struct(F.lit(p).alias("p"), F.floor(F.lit(p) * (F.col("_all") - 1)).alias("r")) for p in probabilities])
    hit = F.filter(ranks, lambda t: (t["r"] < F.col("_upto")) & (t["r"] >= F.col("_upto") - F.col("n")))
    rows = running.select(*keys, F.col("_all").alias("n_values"), "bucket", F.explode(hit).alias("_t"))
    return rows.select(*keys, "n_values", F.col("_t.p").alias("p"), "bucket", bucket_value(F.col("bucket"), accuracy).alias("estimate"))


#: Repeated keys that may be shared with every task, 16 bytes each.
SHARED_KEYS = 4_000_000


def once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without repeats of ``keys``. Only the keys of all rows and the rows that repeat move; the others stay where they are read."""
    repeated = materialise(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*keys))
    known = F.broadcast(repeated) if repeated.count() <= SHARED_KEYS else repeated
    return rows.join(known, keys, "left_anti").unionByName(rows.join(known, keys, "left_semi").dropDuplicates(keys))


def event_readings(events: DataFrame) -> DataFrame:
    """(group_id, channel_idx, day, reading): one row per reading, each event_id once."""
    rows = events.filter("event_id IS NOT NULL AND event_values IS NOT NULL").select("event_id", "group_id", F.to_date("loaded_at").alias("day"), "event_values")
    return once(rows, ["event_id"]).select("group_id", "day", F.posexplode("event_values").alias("channel_idx", "reading"))


def event_sketches(events: DataFrame) -> DataFrame:
    """Sketches of every channel of every group for each day of loading."""
    return sketch(event_readings(events), ["group_id", "channel_idx", "day"], "reading")


def series_sketches(series: DataFrame) -> DataFrame:
    """Sketches of the raw medians of every cytometer and mass for each day of loading; a bin that repeats counts once."""
    rows = series.filter("series_id IS NOT NULL AND bin_idx IS NOT NULL").select("series_id", "bin_idx", "cytometer", "mass_number", F.to_date("loaded_at").alias("day"), "raw_median")
    return sketch(once(rows, ["series_id", "bin_idx"]), ["cytometer", "mass_number", "day"], "raw_median")
