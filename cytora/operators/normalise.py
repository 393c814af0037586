"""Drift of mass cytometers: beads found in several isotopes, their medians over time, and factors for every mass channel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytora.functions.exprs import at_least, at_most, fin
from cytora.operators import beads, stats
from cytora.session import materialise

# Beads a sample has at least, isotopes of a bead at least.
LEAST_BEADS, LEAST_ISOTOPES = 20, 2


@dataclass(frozen=True)
class Isotope:
    """A bead's isotope: its mass, the channel that reads it, and the reading it should have."""

    mass: int
    channel: str
    reference: float = 4000.0


class BeadError(ValueError):
    """Beads that can't be used."""


def check(isotopes: list[Isotope], columns: list[str]) -> list[Isotope]:
    """The isotopes by mass, after the checks that every step relies on."""
    if len(isotopes) < LEAST_ISOTOPES:
        raise BeadError("at least two bead isotopes are needed")
    if any(not 0 < i.reference < float("inf") for i in isotopes):
        raise BeadError("every reference must be finite and positive")
    if len({i.mass for i in isotopes}) < len(isotopes):
        raise BeadError("a mass has more than one channel")
    missing = [i.channel for i in isotopes if i.channel not in columns]
    if missing:
        raise BeadError(f"missing channels: {', '.join(missing)}")
    return sorted(isotopes, key=lambda i: i.mass)


def windows(events: DataFrame, sample: str, isotopes: list[Isotope]) -> DataFrame:
    """(sample, low_<mass>, high_<mass>...): the bead window of each isotope."""
    out = None
    for i in isotopes:
        one = beads.isotope_window(events, sample, i.channel).withColumnsRenamed({"low": f"low_{i.mass}", "high": f"high_{i.mass}"})
        out = one if out is None else out.join(one, sample)
    return out


def dna_windows(events: DataFrame, sample: str, dna: str, isotopes: list[Isotope], share: float = 0.5) -> DataFrame:
    """(sample, dna_low_<mass>, dna_high_<mass>...): the range of DNA below which the events high in an isotope are beads.

    It begins at the least DNA of those events and ends in the widest gap of their DNA values on the arcsinh scale, where the
    cumulative share stands still between beads and beads with cells.
    """
    out = None
    for i in isotopes:
        high = events.filter(at_least(F.col(i.channel), F.col(f"low_{i.mass}")) & at_most(F.col(i.channel), F.col(f"high_{i.mass}")) & fin(F.col(dna))).select(sample, dna)
        low = high.groupBy(sample).agg(F.min(dna).cast("double").alias(f"dna_low_{i.mass}"))
        gap = beads.widest_gap(high, sample, dna).withColumnRenamed("boundary", f"dna_high_{i.mass}")
        one = low.join(gap, sample)
        out = one if out is None else out.join(one, sample)
    return out


def gates(isotopes: list[Isotope], dna: str | None = None) -> tuple[Column, Column]:
    """(is a bead, is associated with one): within all windows of isotope and DNA; and high in all isotopes whatever its DNA."""
    inside, associated = F.lit(True), F.lit(True)
    for i in isotopes:
        x = F.col(i.channel)
        reached = at_least(x, F.col(f"low_{i.mass}"))
        associated = associated & reached
        inside = inside & reached & at_most(x, F.col(f"high_{i.mass}"))
        if dna is not None:
            inside = inside & at_least(F.col(dna), F.col(f"dna_low_{i.mass}")) & at_most(F.col(dna), F.col(f"dna_high_{i.mass}"))
    return inside, associated


def annotated(events: DataFrame, sample: str, isotopes: list[Isotope], dna: str | None = None) -> DataFrame:
    """Events with ``is_bead`` and ``is_removed``."""
    isotopes = check(isotopes, events.columns)
    found = events.join(materialise(windows(events, sample, isotopes)), sample)  # a row a sample
    if dna is not None:
        found = found.join(materialise(dna_windows(found, sample, dna, isotopes)), sample)
    bead, removed = gates(isotopes, dna)
    return found.withColumns({"is_bead": bead, "is_removed": removed}).select(*events.columns, "is_bead", "is_removed")


def time_dynamics(marked: DataFrame, sample: str, time: str, isotopes: list[Isotope], order: list[str]) -> DataFrame:
    """(sample, bin, n, time, one median per isotope): beads in equally filled bins of time; samples of fewer than 20 beads have none.

    Two bins at least: a sample with one is cut in its middle.
    """
    rows = marked.filter("is_bead").filter(fin(F.col(time)))
    channels = [i.channel for i in isotopes]
    binned = materialise(beads.time_bins(rows, sample, time, channels, order))
    positive = F.lit(True)
    for c in channels:
        positive = positive & (F.col(c) > 0)
    bad = binned.filter(~F.coalesce(positive, F.lit(False))).select(sample).distinct()
    return binned.join(bad, sample, "left_anti")


def across_mass(factors: list[tuple[int, Column]], mass: int) -> Column:
    """Factor of a mass from those of the bead's isotopes: straight between neighbours, and on beyond the outer two."""
    if len(factors) < LEAST_ISOTOPES:
        raise BeadError("at least two bead isotopes are needed")
    known = sorted(factors, key=lambda f: f[0])
    for m, f in known:
        if m == mass:
            return f
    upper = next((k for k, (m, _) in enumerate(known) if m > mass), len(known) - 1)
    (m0, f0), (m1, f1) = known[max(upper, 1) - 1], known[max(upper, 1)]
    return f0 + (f1 - f0) * ((mass - m0) / (m1 - m0))


def normalised(events: DataFrame, sample: str, time: str, isotopes: list[Isotope], masses: dict[str, int], order: list[str], dna: str | None = None, remove: bool = False) -> DataFrame:
    """Events whose mass channels are brought to the beads' references: every channel of ``masses`` times the factor of its mass at the event's time.

    A factor is the reference over the bead median interpolated in time, and straight between isotopes in mass. Other channels stay. Samples
    without enough beads, or with a bin without positive signal, have no rows; events whose factor isn't finite and positive
    neither. ``remove`` leaves out events associated with beads.
    """
    isotopes = check(isotopes, events.columns)
    marked = annotated(events, sample, isotopes, dna)
    medians = materialise(time_dynamics(marked, sample, time, isotopes, order))  # 200 rows a sample at most
    rows = marked.filter(~F.col("is_removed")) if remove else marked
    knots = medians.select(sample, F.col(time).alias("_kt"), *[F.col(i.channel).alias(f"_k{i.mass}") for i in isotopes])
    rows = beads.asof_interpolate(rows, knots, [sample], time, "_kt", [f"_k{i.mass}" for i in isotopes], [f"_m{i.mass}" for i in isotopes])
    factors = [(i.mass, F.lit(i.reference) / F.col(f"_m{i.mass}")) for i in isotopes]
    each = {f"_f{m}": across_mass(factors, m) for m in sorted(set(masses.values()))}
    rows = rows.withColumns(each)
    sound = F.lit(True)
    for f in each:
        sound = sound & fin(F.col(f)) & (F.col(f) > 0)
    rows = rows.filter(F.coalesce(sound, F.lit(False)))
    return rows.withColumns({c: (F.col(c).cast("double") * F.col(f"_f{m}")).cast("float") for c, m in masses.items()}).select(*events.columns)


def report(marked: DataFrame, sample: str) -> DataFrame:
    """(sample, beads, removed, events)."""
    return marked.groupBy(sample).agg(F.sum(F.col("is_bead").cast("long")).alias("beads"), F.sum(F.col("is_removed").cast("long")).alias("removed"), F.count(F.lit(1)).alias("events"))


def median_shift(before: DataFrame, after: DataFrame, sample: str, channels: list[str]) -> DataFrame:
    """(sample, channel medians before and after) of a normalisation."""
    a = stats.exact_medians(before, [sample], channels)
    b = stats.exact_medians(after, [sample], channels).withColumnsRenamed({c: f"{c}_after" for c in channels})
    return a.join(b, sample)
