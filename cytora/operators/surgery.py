"""Sample surgery: splitting, joining and sampling samples, metadata upserts, categories, platform inputs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytora.operators import ordered


def fragments(time: Column, cuts: list[float]) -> Column:
    """Number of the half-open fragment a time falls into, the last one closed; null outside."""
    edges = sorted(cuts)
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        last = i == len(edges) - 2
        out = F.when((time >= edges[i]) & ((time <= edges[i + 1]) if last else (time < edges[i + 1])), F.lit(i)).otherwise(out)
    return F.when(~F.isnan(time), out)


def half_away(value: float) -> int:
    """Rounded half away from zero, as split points are."""
    return int(abs(value) + 0.5) * (1 if value >= 0 else -1)


def time_steps(df: DataFrame, sample: str, time: str, cap: float = 1.0) -> DataFrame:
    """(sample, step): the smallest positive difference of successive times, at most ``cap``."""
    before = ordered.previous(df.select(sample, time).filter(F.col(time).isNotNull() & ~F.isnan(time)).distinct(), [time], time, "_before", sample)
    gap = F.col(time) - F.col("_before")
    return before.groupBy(sample).agg(F.least(F.coalesce(F.min(F.when(gap > 0, gap)), F.lit(float(cap))), F.lit(float(cap))).alias("step"))


def join_times(df: DataFrame, sample: str, time: str, order: list[str]) -> DataFrame:
    """Times of samples laid one after the other, in the order of the list: each starts a step after the one before."""
    ends = df.groupBy(sample).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi")).join(time_steps(df, sample, time), sample)
    place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(sample))
    w = Window.partitionBy(F.lit(0)).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)  # one row per sample of the list
    shift = ends.withColumn("_place", place).filter("_place > 0").withColumn("_offset", F.coalesce(F.sum(F.col("_hi") - F.col("_lo") + F.col("step")).over(w), F.lit(0.0)))
    return df.join(shift.select(sample, "_lo", "_offset"), sample).withColumn("joined_time", F.col(time) - F.col("_lo") + F.col("_offset")).drop("_lo", "_offset")


def stride(df: DataFrame, index: str, total: Column, keep: int) -> DataFrame:
    """Rows ``floor(i * total / keep)`` for i = 0, 1, ...: a filter on the row's place, without a sort."""
    idx = F.col(index).cast("long")
    i = F.ceil(idx * keep / total)
    return df.filter((total <= keep) | ((i < keep) & (F.floor(i * total / keep) == idx)))


def reservoir(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """A uniform sample of at most ``size`` rows that depends on keys and seed only.

    Rows are the ones of the smallest hashes, ties by key; the hash and the key of the last one are found as an exact
    order statistic, so that keeping rows is a filter, whatever the size. Rows that repeat a key are kept or left together as far as size allows.
    """
    if size <= 0:
        return df.limit(0)
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
    top = F.shiftright(F.col("_h"), 44).cast("int")  # 2^20 counts at most
    counted = hashed.groupBy(top.alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    upto = counted.withColumn("_upto", F.sum("_n").over(Window.orderBy("_t")))
    border = upto.filter(F.col("_upto") >= size).orderBy("_t").limit(1).collect()
    if not border:
        return df
    at, before = border[0]["_t"], border[0]["_upto"] - border[0]["_n"]
    w = Window.orderBy("_h", key)  # the rows of one of 2^20 counts
    last = hashed.filter(top == at).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= size - before).drop("_r")
    return hashed.filter(top < at).unionByName(last).drop("_h")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` with the columns of ``new``; columns that ``new`` lacks go, but for the keys."""
    fresh = new.dropDuplicates(keys)
    return old.select(*keys).join(fresh, keys, "left")


def infer_kind(values: Column) -> Column:
    """Integer, Float or String: what all non-blank values of a metadata column are (an aggregate)."""
    text = F.trim(values)
    present = values.isNotNull() & (text != "")
    whole, number = text.rlike(r"^[+-]?\d{1,9}$"), text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return (
        F.when(F.coalesce(F.sum(present.cast("int")), F.lit(0)) == 0, "String")
        .when(F.bool_and(F.when(present, whole)), "Integer")
        .when(F.bool_and(F.when(present, number)), "Float")
        .otherwise("String")
    )


def batch_ids(df: DataFrame, label: str) -> DataFrame:
    """Adds batch_id: the place of the label among the distinct labels in order."""
    labels = df.select(label).filter(F.col(label).isNotNull()).distinct()
    numbered = labels.withColumn("batch_id", (F.dense_rank().over(Window.orderBy(label)) - 1).cast("int"))  # labels only
    return df.join(numbered, label)


def categories(df: DataFrame, sample: str, label: str, order: str) -> DataFrame:
    """(sample, label, category_id): ids in the order in which labels first appear."""
    first = df.filter(F.col(label).isNotNull()).groupBy(sample, label).agg(F.min(order).alias("_first"))
    w = Window.partitionBy(sample).orderBy("_first", label)
    return first.select(sample, label, (F.row_number().over(w) - 1).cast("int").alias("category_id"))


def write_back(events: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Events with ``value`` replaced where ``new`` has one."""
    fresh = new.select(*keys, F.col(value).alias("_new"))
    old = F.col(value) if value in events.columns else F.lit(None)
    return events.join(fresh, keys, "left").withColumn(value, F.coalesce("_new", old)).drop("_new")


def natural_key(name: str) -> tuple:
    """Sort key of channel names: digit runs as numbers, letters without case."""
    return tuple((0, int(p), "") if p.isdigit() else (1, 0, p.lower()) for p in re.findall(r"\d+|\D+", name))


def unique_name(name: str, taken: set[str], ignore_case: bool = False) -> str:
    """``name``, or ``name 2``, ``name 3`` ... if it is taken."""
    fold = (lambda s: s.lower()) if ignore_case else (lambda s: s)
    used, k, out = {fold(t) for t in taken}, 2, name
    while fold(out) in used:
        out, k = f"{name} {k}", k + 1
    return out
