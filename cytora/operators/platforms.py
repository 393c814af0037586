"""Inputs of model jobs: rows of chosen populations with a row map, transforms of their features, and results written back."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytora.functions import exprs as X
from cytora.functions.exprs import Axis, fin
from cytora.operators import stats, surgery
from cytora.operators.channels import ChannelError


class OverlapError(ValueError):
    """An event belongs to more than one source of an integration."""


@dataclass(frozen=True)
class Source:
    """A population of a sample (of every sample, if ``sample`` is None), by the name of its mask."""

    population: str
    sample: str | None = None


def marked(events: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """Events with the list of populations that hold each, in the order of the masks."""
    return events.withColumn("populations", F.filter(F.array(*[F.when(m, F.lit(n)) for n, m in masks.items()]), lambda v: v.isNotNull()))


def population_column(events: DataFrame, masks: dict[str, Column], out: str = "population", none: str | None = None) -> DataFrame:
    """Adds the label of the last population of the tree that holds each event, ``none`` where no one does."""
    label = F.coalesce(*[F.when(m, F.lit(n)) for n, m in reversed(list(masks.items()))], F.lit(none).cast("string"))
    return events.withColumn(out, label)


def population_ids(masks: dict[str, Column]) -> dict[str, int]:
    """Category id of every population, in the order in which they are first seen in the tree."""
    return {n: i for i, n in enumerate(masks)}


def source_rows(events: DataFrame, masks: dict[str, Column], sources: list[Source], features: list[str], sample: str, event: str, keep: list[str] | None = None) -> DataFrame:
    """(source_id, sample, population, event, keep..., features...): rows of the sources, numbered as they are listed.

    An event in several sources has a row for each (see ``overlaps``). Unknown populations and missing features are errors.
    """
    unknown = [s.population for s in sources if s.population not in masks]
    if unknown:
        raise KeyError(f"no population {', '.join(unknown)}")
    missing = [f for f in features if f not in events.columns]
    if missing:
        raise ChannelError(f"missing channels: {', '.join(missing)}")
    tests = [masks[s.population] & (F.lit(True) if s.sample is None else F.col(sample).eqNullSafe(s.sample)) for s in sources]
    own = F.filter(F.array(*[F.when(t, F.struct(F.lit(i).alias("source_id"), F.lit(s.population).alias("population"))) for i, (t, s) in enumerate(zip(tests, sources))]), lambda v: v.isNotNull())
    rows = events.select(sample, event, *(keep or []), *features, F.inline(own))
    return rows.select("source_id", sample, "population", event, *(keep or []), *features)


def overlaps(rows: DataFrame, sample: str, event: str) -> DataFrame:
    """(sample, event, sources): events that more than one source holds."""
    return rows.groupBy(sample, event).agg(F.count(F.lit(1)).alias("sources")).filter(F.col("sources") > 1)


def row_map(rows: DataFrame, sample: str, event: str, group: str, group_id: str, gates: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(source_id, group, sample, population, group_id, sample_id, gate_id, region, event_index): where each row of a job comes from.

    ``gates`` names gate and region of a population; else they are read from ``gate:Region``.
    """
    gate, region = F.split("population", ":")[0], F.coalesce(F.get(F.split("population", ":"), F.lit(1)), F.lit("Primary"))
    for name, (g, r) in (gates or {}).items():
        gate, region = F.when(F.col("population") == name, g).otherwise(gate), F.when(F.col("population") == name, r).otherwise(region)
    return rows.select(
        "source_id", F.lit(group).alias("group"), F.col(sample).alias("sample"), "population", F.lit(group_id).alias("group_id"),
        F.col(sample).cast("string").alias("sample_id"), gate.alias("gate_id"), region.alias("region"), F.col(event).cast("long").alias("event_index"),
    )


def platform_input(events: DataFrame, masks: dict[str, Column], sources: list[Source], features: list[str], sample: str, event: str, batch: str | None = None, integration: bool = False) -> DataFrame:
    """Rows of a job with ``source_id``, ``row`` order columns and, with ``batch``, ``batch_id`` by the ordinal order of its labels.

    An integration must not hold an event twice; rows without a batch label are an error there too, named with their sample.
    """
    rows = source_rows(events, masks, sources, features, sample, event, [batch] if batch else None)
    if integration:
        twice = overlaps(rows, sample, event).first()
        if twice is not None:
            raise OverlapError(f"event {twice[event]} of sample {twice[sample]} belongs to {twice['sources']} sources")
    if batch is None:
        return rows
    if integration:
        lacking = rows.filter(F.col(batch).isNull()).select(sample).first()
        if lacking is not None:
            raise ValueError(f"sample {lacking[sample]} has no {batch}")
    return surgery.batch_ids(rows, batch)


def has_batches(rows: DataFrame, batch: str) -> bool:
    """Whether there is more than one batch to integrate."""
    return rows.select(batch).filter(F.col(batch).isNotNull()).distinct().limit(2).count() > 1


def _forward(c: Column, axis: Axis) -> Column:
    return axis.forward(c.cast("double"))


def transformed(rows: DataFrame, features: list[str], axis: Axis) -> DataFrame:
    """Every feature on one axis, single precision, as model fits of one variable take them: the logarithm of what isn't finite is NaN."""
    one = lambda c: F.when(fin(F.col(c)), _forward(F.col(c), axis)).otherwise(F.lit(float("nan"))) if axis.kind == "log" else _forward(F.col(c), axis)
    return rows.withColumns({c: one(c).cast("float") for c in features})


def integration_transformed(rows: DataFrame, axes: dict[str, Axis]) -> DataFrame:
    """Each feature on its own axis, single precision; what isn't finite is NaN whatever the axis."""
    return rows.withColumns({c: F.when(fin(F.col(c)), _forward(F.col(c), a)).otherwise(F.lit(float("nan"))).cast("float") for c, a in axes.items()})


def scaled(rows: DataFrame, features: list[str], kinds: dict[str, str] | None = None, keys: list[str] | None = None, kind_columns: dict[str, str] | None = None) -> DataFrame:
    """Features normalised by the kind of each (or of each cell, in ``kind_columns``): linear ones by mean and sample deviation of
    their finite linear cells, arcsinh ones with a cofactor of 5. A deviation that is no positive number counts as 1."""
    keys = keys or []
    kind = {c: F.col(kind_columns[c]) if kind_columns and c in kind_columns else F.lit((kinds or {}).get(c, "Linear")) for c in features}
    linear = {c: F.when((kind[c] == "Linear") & fin(F.col(c)), F.col(c).cast("double")) for c in features}
    sums = rows.groupBy(*keys).agg(*[f(linear[c]).alias(f"_{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    joined = rows.join(sums, keys) if keys else rows.join(F.broadcast(sums))  # one row
    out = {}
    for c in features:
        s = F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
        out[c] = F.when(kind[c] == "Linear", (F.col(c) - F.coalesce(f"_m_{c}", F.lit(0.0))) / s).when(kind[c] == "Arcsinh", X.arcsinh(F.col(c) / 5.0)).otherwise(F.col(c).cast("double")).cast("float")
    return joined.withColumns(out).select(*rows.columns)


def concatenated(events: DataFrame, masks: dict[str, Column], chosen: dict[str, list[str]], sample: str, name: str, time: str | None = None) -> DataFrame:
    """One sample ``name`` of the chosen populations of several samples, each event once, in the order of samples given.

    With ``time``, the samples' times are laid one after the other.
    """
    unknown = [p for ps in chosen.values() for p in ps if p not in masks]
    if unknown:
        raise KeyError(f"no population {', '.join(unknown)}")
    test = reduce(lambda a, b: a | b, [(F.col(sample) == s) & reduce(lambda a, b: a | b, [masks[p] for p in ps], F.lit(False)) for s, ps in chosen.items()], F.lit(False))
    rows = events.filter(test)
    if time is not None:
        rows = surgery.join_times(rows, sample, time, list(chosen)).withColumn(time, F.col("joined_time")).drop("joined_time")
    return rows.withColumn("source_sample", F.col(sample)).withColumn(sample, F.lit(name))


def demultiplexed(events: DataFrame, mask: Column, channels: list[str], sample: str, least: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(events of derived samples, their metadata): one sample for each combination of positive channels.

    ``mask`` holds bit k for channel k, -1 for events that belong to none. ``least`` (sample, threshold) leaves out
    combinations of fewer events. A derived id is stable: a hash of the sample and the signature.
    """
    signature = F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.when(F.col("_mask").bitwiseAND(1 << k) > 0, "+").otherwise("-")) for k, c in enumerate(channels)])
    rows = events.withColumn("_mask", mask).filter("_mask >= 0").withColumn("signature", signature)
    sizes = rows.groupBy(sample, "signature", "_mask").agg(F.count(F.lit(1)).alias("events"))
    if least is not None:
        sizes = sizes.join(least.select(F.col(sample).alias("_ls"), "threshold"), F.col(sample) == F.col("_ls"), "left").filter(F.col("threshold").isNull() | (F.col("events") >= F.col("threshold"))).drop("_ls", "threshold")
    derived = F.sha2(F.concat_ws("/", F.col(sample), F.col("signature")), 256)
    meta = sizes.select(derived.alias("derived_id"), F.col(sample).alias("source_sample"), "signature", F.col("_mask").alias("mask"), "events")
    kept = rows.join(sizes.select(sample, "signature"), [sample, "signature"], "left_semi").withColumn("derived_id", derived).drop("_mask")
    return kept, meta


class OwnedError(ValueError):
    """The target of a commit belongs to something else."""


def commit(target: DataFrame | None, owner: str | None, source: str, derived: DataFrame, stamps: dict[str, str]) -> DataFrame:
    """Derived samples as the content of a target that is empty or was written by the same ``source``, with provenance columns."""
    if target is not None and owner != source and not target.isEmpty():
        raise OwnedError("the target group must be empty or belong to the same source")
    return derived.withColumns({"provenance_source": F.lit(source), **{f"provenance_{k}": F.lit(v) for k, v in stamps.items()}})


def brightest(rows: DataFrame, group: str, value: str, event: str, most: int) -> DataFrame:
    """The ``most`` rows of the largest values of each group, ties by event; Spark keeps a bounded heap a task."""
    w = Window.partitionBy(group).orderBy(F.col(value).desc(), event)
    return rows.filter(fin(F.col(value))).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def above_blank(rows: DataFrame, group: str, blank: object, value: str, probability: float = 0.99) -> DataFrame:
    """Rows of all groups but the blank one whose value exceeds the blank's quantile."""
    level = stats.exact_quantiles(rows.filter(F.col(group) == blank), [], [value], [probability]).select(F.col("q")[0].alias("_level"))
    return rows.filter(F.col(group) != blank).join(F.broadcast(level)).filter(X.above(F.col(value), F.col("_level"))).drop("_level")  # one row


def in_range(rows: DataFrame, value: str, one: float, other: float) -> DataFrame:
    """Rows within an inclusive range, its ends in any order."""
    low, high = sorted((one, other))
    return rows.filter(X.at_least(F.col(value), low) & X.at_most(F.col(value), high))


def even_places(total: int, most: int) -> list[int]:
    """Places of at most ``most`` rows evenly spread over ``total``, rounded to the nearest, first and last included."""
    if total <= most:
        return list(range(total))
    return sorted({int(i * (total - 1) / (most - 1) + 0.5) for i in range(most)}) if most > 1 else [0]
