"""Channels: what kind a channel is, projections, and the values of a channel or of an embedding that shadows it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name of a mass channel: element and mass in either order, with an optional suffix.
_MASS_NAME = re.compile(r"(?:[A-Z][a-z]?\d{2,3}|\d{2,3}[A-Z][a-z]?)(?:d[id])?", re.I)
_MODEL_NAME = re.compile(r"width|center|offset|residual|event_?length", re.I)
MARKER_KINDS = ("Optical", "Spectrum", "Mass")


def channel_kind(kind: str | None, name: str | None) -> str:
    """Kind of a channel; where it is not given, what its name says."""
    if kind and kind.strip():
        return kind.strip()
    text = (name or "").strip()
    upper = text.upper()
    if "TIME" in upper:
        return "Time"
    if "FSC" in upper or "SSC" in upper:
        return "Scatter"
    if upper.startswith("BCKG"):
        return "Background"
    if _MODEL_NAME.match(text):
        return "Model"
    return "Mass" if _MASS_NAME.fullmatch(text) else "Optical"


def kind_column(kind: Column, name: Column) -> Column:
    """The same as an expression."""
    text, given = F.trim(F.coalesce(name, F.lit(""))), F.trim(F.coalesce(kind, F.lit("")))
    upper = F.upper(text)
    return (
        F.when(given != "", given).when(upper.contains("TIME"), "Time").when(upper.contains("FSC") | upper.contains("SSC"), "Scatter").when(upper.startswith("BCKG"), "Background")
        .when(text.rlike(f"(?i)^(?:{_MODEL_NAME.pattern})"), "Model").when(text.rlike(f"(?i)^(?:{_MASS_NAME.pattern})$"), "Mass").otherwise("Optical")
    )


def is_compensable(name: str, kind: str | None = None) -> bool:
    """Whether spillover can be corrected in a channel: it is neither scatter nor time."""
    return channel_kind(kind, name) not in ("Scatter", "Time")


class ChannelError(ValueError):
    """Channels that an operation needs are missing."""


def projected(events: DataFrame, channels: list[str], keys: list[str]) -> DataFrame:
    """Events with the channels named, in that order, after the key columns; missing ones are an error."""
    missing = [c for c in channels if c not in events.columns]
    if missing:
        raise ChannelError(f"missing channels: {', '.join(missing)}")
    return events.select(*keys, *channels)


def channel_values(events: DataFrame, channel: str, keys: list[str], embeddings: DataFrame | None = None, value: str = "value") -> DataFrame:
    """(keys..., value): an embedding of the name shadows the channel; events it has no value for are NaN. An unknown channel has no rows.

    ``embeddings`` holds (keys..., name, value).
    """
    if embeddings is not None:
        own = embeddings.filter(F.col("name") == channel).select(*keys, F.col("value").cast("float").alias("_e"))
        if not own.isEmpty():
            return events.select(*keys).join(own, keys, "left").select(*keys, F.coalesce("_e", F.lit(float("nan")).cast("float")).alias(value))
    if channel not in events.columns:
        return events.select(*keys, F.lit(None).cast("float").alias(value)).limit(0)
    return events.select(*keys, F.col(channel).cast("float").alias(value))


def control_values(events: DataFrame, channel: str, wanted: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys..., value): raw values of the rows of a control that are asked for; rows that it doesn't have are NaN."""
    raw = events.select(*keys, F.col(channel).cast("float").alias("_e")) if channel in events.columns else events.select(*keys, F.lit(None).cast("float").alias("_e"))
    return wanted.select(*keys).join(raw, keys, "left").select(*keys, F.coalesce("_e", F.lit(float("nan")).cast("float")).alias(value))


def shared_channels(channels: DataFrame, sample: str, name: str) -> DataFrame:
    """(name): channels that every sample has, in ordinal order."""
    pairs = channels.select(sample, name).filter(F.col(sample).isNotNull() & F.col(name).isNotNull()).distinct()
    samples = pairs.select(sample).distinct().agg(F.count(F.lit(1)).alias("_all"))
    counted = pairs.groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    return counted.join(F.broadcast(samples)).filter("_n = _all").select(name).orderBy(name)  # one row


def import_control(events: DataFrame, channels: list[str], keys: list[str]) -> DataFrame:
    """A control's events in the order of the group's channels; a control that lacks one is rejected by name."""
    return projected(events, channels, keys).withColumn("role", F.lit("control"))
