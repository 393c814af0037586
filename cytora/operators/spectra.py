"""Spectral controls: peaks, positives, blanks near in scatter, signatures, and the unmixing that follows from them.

Events come as (control, event, scatter array, detector array). Where a step works on a bounded set by definition (3 000
positives of a control, 3 000 blanks, 5 000 events for a peak), the set is that of the method and its number is named below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytora.functions.exprs import fin
from cytora.operators import linalg, ordered, stats
from cytora.session import materialise, spread

# Positives and blanks that a signature is made of, events that a peak is looked for in, blank events next
# in scatter, the quantile of the blank that positives exceed, and events a gate has to hold.
POSITIVES, BLANKS, PEAK_EVENTS, NEIGHBOURS, BLANK_QUANTILE, LEAST = 3000, 3000, 5000, 2, 0.99, 3


class SpectralError(ValueError):
    """Controls from which no signature can be made."""


def raw_gate(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Even-odd test on raw values; fewer than three vertices hold every event."""
    from cytora.functions.exprs import inside_polygon

    return inside_polygon(x.cast("double"), y.cast("double"), vertices) if len(vertices) >= 3 else F.lit(True)


def even_sample(events: DataFrame, control: str, event: str, most: int) -> DataFrame:
    """At most ``most`` events of every control, evenly spaced in their order: those at ``floor(i * n / most)``."""
    placed = ordered.row_index(events.select(control, event), [event], "_i", control, "_n")
    i = F.ceil(F.col("_i") * most / F.col("_n"))
    kept = placed.filter((F.col("_n") <= most) | ((i < most) & (F.floor(i * F.col("_n") / most) == F.col("_i")))).select(control, event)
    return events.join(kept, [control, event], "left_semi")


def detector_means(events: DataFrame, control: str, detectors: str) -> DataFrame:
    """(control, detector, mean) of the finite values."""
    each = events.select(control, F.posexplode(detectors).alias("detector", "v")).filter(fin(F.col("v")))
    return each.groupBy(control, "detector").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def peaks(stained: DataFrame, blank: DataFrame, control: str, detectors: str) -> DataFrame:
    """(control, peak): detector of the largest mean once the blank's direction is taken out of every event; ties to the first detector.

    Taking a direction out is linear, so the mean of the cleaned events is the cleaned mean wherever all values are finite;
    values that aren't are left out of projections and of means alike.
    """
    af = detector_means(blank, control, detectors).select(F.col("detector").alias("_d"), F.col("mean").alias("_b"))
    norm = af.agg(F.sqrt(F.sum(F.col("_b") * F.col("_b"))).alias("_norm"))
    unit = af.join(F.broadcast(norm)).select("_d", F.when(F.col("_norm") > 0, F.col("_b") / F.col("_norm")).otherwise(0.0).alias("_u"))  # one row
    listed = unit.agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_u"))), lambda s: s["_u"]).alias("_unit"))  # one row of as many numbers as detectors
    both = stained.join(F.broadcast(listed), how="left")
    dot = F.aggregate(F.zip_with(detectors, F.coalesce("_unit", F.array()), lambda v, u: F.when(fin(v), v.cast("double") * u).otherwise(0.0)), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    clean = F.zip_with(detectors, F.coalesce("_unit", F.array()), lambda v, u: F.when(fin(v), v.cast("double") - F.coalesce(u, F.lit(0.0)) * F.col("_dot")))
    cleaned = both.withColumn("_dot", dot).select(control, F.posexplode(clean).alias("detector", "v"))
    means = cleaned.groupBy(control, "detector").agg(F.avg("v").alias("mean"))
    return means.groupBy(control).agg(F.min_by("detector", F.struct(-F.col("mean"), F.col("detector"))).alias("peak"))


def positives(stained: DataFrame, blank: DataFrame, peak: DataFrame, control: str, event: str, detectors: str, most: int = POSITIVES, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """The brightest events at each control's peak that exceed the blank's quantile there, ``most`` at most, ties by event; with ``bright``.

    ``ranges`` restricts controls to a range of values, its ends in any order.
    """
    at = lambda df: df.select("*", F.get(detectors, F.col("peak")).cast("double").alias("bright")).filter(fin(F.col("bright")))
    bright = at(stained.join(peak, control))
    used = peak.select("peak").distinct()
    level = stats.exact_quantiles(at(blank.drop(control).join(used)), ["peak"], ["bright"], [BLANK_QUANTILE]).select("peak", F.col("q")[0].alias("_level"))
    above = bright.join(level, "peak").filter(F.col("bright") > F.col("_level")).drop("_level")
    for name, ends in (ranges or {}).items():
        low, high = sorted(ends)
        above = above.filter((F.col(control) != name) | F.col("bright").between(low, high))
    w = Window.partitionBy(control).orderBy(F.col("bright").desc(), event)
    return above.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def nearest_blanks(queries: DataFrame, blank: DataFrame, event: str, scatter: str, keep: list[str], k: int = NEIGHBOURS, most: int = BLANKS) -> DataFrame:
    """(keep..., blank, rank): the ``k`` blanks nearest in scatter to each query, ties to the first; events without finite scatter take no part.

    Blanks are compared in blocks of ``most``; each block is shared with the tasks and the best of all blocks are kept, so any number
    of blanks will do.
    """
    sound = lambda df: df.filter(F.forall(scatter, lambda v: fin(v)))
    side = sound(blank).select(F.col(event).alias("_b"), F.col(scatter).cast("array<double>").alias("_s"))
    total = side.count()
    blocks = max(1, -(-total // most))
    side = side.withColumn("_k", F.pmod(F.xxhash64("_b"), F.lit(blocks)))
    fields = queries.select(*keep).schema
    names = [*keep, "blank", "distance"]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in fields] + ["blank long", "distance double"])
    found: DataFrame | None = None
    asked = sound(queries).select(*keep, F.col(scatter).cast("array<double>").alias("_q"))
    for block in range(blocks):
        rows = side.filter(F.col("_k") == block).toPandas()
        if rows.empty:
            continue
        order = np.argsort(rows["_b"].to_numpy())
        shared = queries.sparkSession.sparkContext.broadcast((rows["_b"].to_numpy()[order], np.stack(rows["_s"].to_numpy()[order])))

        def near(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, b = shared.value
            for batch in batches:
                for a in range(0, batch.num_rows, 512):
                    part = batch.slice(a, 512)
                    q = np.array(part.column("_q").to_pylist())
                    d = ((q[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
                    best = np.argsort(d, axis=1, kind="stable")[:, :k]
                    at = np.repeat(np.arange(len(q)), best.shape[1])
                    columns = [part.column(c).take(pa.array(at)) for c in keep]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(ids[best.ravel()].astype(np.int64)), pa.array(np.take_along_axis(d, best, axis=1).ravel())], names=names)

        pairs = spread(asked).mapInArrow(near, schema)
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        raise SpectralError("no blank event has finite scatter")
    w = Window.partitionBy(*keep).orderBy("distance", "blank")
    return found.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k).drop("distance")


def _normalised(medians: DataFrame, control: str, clip: bool) -> DataFrame:
    """(control, detector, signature): medians over the largest one, single precision."""
    top = F.max("v").over(Window.partitionBy(control))
    value = F.col("v") / F.when(top > 0, top)
    return medians.select(control, "detector", (F.greatest(value, F.lit(0.0)) if clip else value).cast("float").alias("signature"))


def _medians(events: DataFrame, control: str, detectors: str) -> DataFrame:
    each = events.select(control, F.posexplode(detectors).alias("detector", "v"))
    return stats.exact_medians(each, [control, "detector"], ["v"])


def signatures(events: DataFrame, control: str, event: str, scatter: str, detectors: str, blank: str, peak: DataFrame | None = None, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(control, detector, signature) of every stained control and, under the name ``AF``, of the blank one.

    The steps: the peak of each control (given or found), positives above the blank there, the mean of the two blanks nearest
    in scatter taken off each of them, medians of what is left over the largest of them. Events are those within the controls' gates.
    """
    stained, plain = events.filter(F.col(control) != blank), events.filter(F.col(control) == blank)
    few = materialise(even_sample(plain, control, event, BLANKS))
    at = peak if peak is not None else materialise(peaks(even_sample(stained, control, event, PEAK_EVENTS), few, control, detectors))
    bright = materialise(positives(stained, plain, at, control, event, detectors, ranges=ranges).select(control, event, scatter, detectors))
    pairs = nearest_blanks(bright, few, event, scatter, [control, event])
    background = few.select(F.col(event).alias("blank"), F.posexplode(detectors).alias("detector", "b")).filter(fin(F.col("b")))
    mean = pairs.join(background, "blank").groupBy(control, event, "detector").agg(F.avg(F.col("b").cast("double")).alias("b"))
    each = bright.select(control, event, F.posexplode(detectors).alias("detector", "v"))
    corrected = each.join(mean, [control, event, "detector"]).filter(fin(F.col("v"))).select(control, "detector", (F.col("v").cast("double") - F.col("b")).cast("float").alias("v"))
    own = _normalised(stats.exact_medians(corrected, [control, "detector"], ["v"]), control, True)
    af = _normalised(_medians(few, control, detectors), control, False).withColumn(control, F.lit("AF"))
    return own.unionByName(af)


def fit(events: DataFrame, control: str, event: str, scatter: str, detectors: str, blanks: list[str], molecules: dict[str, str], lenient: bool = False, **settings) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(names, signatures, similarities, coefficients): the whole pipeline; ``molecules`` names each stained control's molecule.

    Exactly one blank control, distinct names and at least three events everywhere are required; a control without a signature
    is an error, or left out if ``lenient``.
    """
    if len(blanks) != 1:
        raise SpectralError("exactly one blank control is needed")
    names = [m.strip() for m in molecules.values()]
    if not names or not all(names) or len({m.lower() for m in names}) < len(names):
        raise SpectralError("molecule names must be given and differ")
    known = events.filter(F.col(control).isin([*blanks, *molecules]))
    sizes = {r[control]: r["n"] for r in known.groupBy(control).agg(F.count(F.lit(1)).alias("n")).collect()}  # controls only
    for c in [*blanks, *molecules]:
        if sizes.get(c, 0) < LEAST:
            raise SpectralError(f"the gate of {c} holds fewer than {LEAST} events")
    rows = signatures(known, control, event, scatter, detectors, blanks[0], **settings).toPandas()  # molecules times detectors
    wide = rows.pivot(index=control, columns="detector", values="signature")
    missing = [c for c in [*molecules, "AF"] if c not in wide.index or wide.loc[c].isna().any()]
    if lenient and "AF" not in missing:
        molecules = {c: m for c, m in molecules.items() if c not in missing}
        names = [m.strip() for m in molecules.values()]
    elif missing:
        raise SpectralError(f"no signature with a positive maximum for {', '.join(missing)}")
    s = wide.loc[[*molecules, "AF"]].to_numpy(float)
    return [*names, "AF"], s, linalg.similarity_matrix(s), linalg.unmixing_matrix(s)
