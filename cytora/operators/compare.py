"""Comparison of intensities: every group against a reference group, all groups in one pass over counts of distinct values."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytora.functions.exprs import fin
from cytora.operators import ordered
from cytora.operators.fits import special


def rank_statistics(df: DataFrame, group: str, value: str, reference: str) -> DataFrame:
    """(group, n1, n2, u, ks, ties): Mann-Whitney's U, the Kolmogorov-Smirnov distance and the sum of t^3 - t over tied values, against ``reference``.

    Distinct values are counted, put in order once for the reference's running count and once within the groups. Between two
    values of a group the distance is largest just before the next, so the reference's own values need no row.
    """
    counted = df.filter(fin(F.col(value)) & F.col(group).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_a"))
    mine = F.sum(F.when(F.col("_g") == reference, F.col("_a")).otherwise(0))
    at = ordered.running_sums(counted.groupBy("_v").agg(mine.cast("long").alias("_r")), ["_v"], {"_r": "_upto"})
    own = ordered.running_sums(counted.filter(F.col("_g") != reference).join(at, "_v"), ["_v"], {"_a": "_ua"}, "_g")
    n = counted.groupBy("_g").agg(F.sum("_a").alias("_n"))
    ref = n.filter(F.col("_g") == reference).select(F.col("_n").alias("n2"))
    cube = lambda c: c * c * c - c
    tied = counted.filter(F.col("_g") == reference).agg(F.coalesce(F.sum(cube(F.col("_a").cast("double"))), F.lit(0.0)).alias("_rt"))
    sized = own.join(n, "_g").join(F.broadcast(ref)).join(F.broadcast(tied))  # one row each
    share = lambda c, of: F.col(c) / F.col(of).cast("double")
    before = F.abs((F.col("_ua") - F.col("_a")) / F.col("_n").cast("double") - (F.col("_upto") - F.col("_r")) / F.col("n2").cast("double"))
    here = F.abs(share("_ua", "_n") - share("_upto", "n2"))
    both, r = (F.col("_a") + F.col("_r")).cast("double"), F.col("_r").cast("double")
    return sized.groupBy(F.col("_g").alias(group)).agg(
        F.first("_n").alias("n1"), F.first("n2").alias("n2"), F.sum(F.col("_a") * (F.col("_upto") - F.col("_r") + F.col("_r") / 2.0)).alias("u"),
        F.max(F.greatest(before, here)).alias("ks"), (F.first("_rt") + F.sum(cube(both) - cube(r))).alias("ties"),
    )


def chi_square(df: DataFrame, group: str, value: str, reference: str, low: float, high: float, bins: int) -> DataFrame:
    """(group, chi2, dof): counts in ``bins`` bins of the range against the reference's, brought to the same total; bins empty in both are left out.

    Null where fewer than two bins are left.
    """
    inside = df.filter(F.col(group).isNotNull() & fin(F.col(value)) & (F.col(value) >= low) & (F.col(value) <= high))
    at = F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    counted = inside.groupBy(F.col(group).alias("_g"), at.alias("_b")).agg(F.count(F.lit(1)).cast("double").alias("_o"))
    expected = counted.filter(F.col("_g") == reference).select(F.col("_b").alias("_eb"), F.col("_o").alias("_e"))
    groups = df.filter(F.col(group).isNotNull() & (F.col(group) != reference)).select(F.col(group).alias("_g")).distinct()
    grid = groups.select("_g", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("_b"))
    both = grid.join(counted, ["_g", "_b"], "left").join(expected, F.col("_b") == F.col("_eb"), "left")
    o, e = F.coalesce("_o", F.lit(0.0)), F.coalesce("_e", F.lit(0.0))
    kept = both.select("_g", o.alias("o"), e.alias("e")).filter("o + e > 0").withColumn("e", F.col("e") + 1e-9)
    total = kept.groupBy("_g").agg(F.greatest(F.sum("o"), F.lit(1.0)).alias("_so"), F.greatest(F.sum("e"), F.lit(1.0)).alias("_se"), F.count(F.lit(1)).alias("_k"))
    scaled = kept.join(total, "_g").withColumn("e", F.col("e") * F.col("_so") / F.col("_se"))
    chi = scaled.groupBy("_g").agg(F.sum((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")) / F.col("e")).alias("c"), F.first("_k").alias("_k"))
    enough = lambda c: F.when(F.col("_k") >= 2, c)
    return chi.select(F.col("_g").alias(group), enough(F.col("c")).alias("chi2"), enough(F.col("_k") - 1).cast("int").alias("dof"))


def moments(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, mean, var, skew, kurt) of the finite values."""
    v = F.when(fin(F.col(value)), F.col(value).cast("double"))
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurt"))


_TESTS = "double, ".join(["normality_p ", "z_p ", "mann_whitney_p ", "ks_p ", "chi_square_p "]) + "double"


def intensity_tests(df: DataFrame, group: str, value: str, reference: str, low: float, high: float, bins: int = 500) -> DataFrame:
    """(group, normality_p, z_p, mann_whitney_p, ks_p, chi_square_p): probabilities of the tests of every group; the reference has its own normality only.

    NaN where a test has too few values.
    """
    m = moments(df, group, value)
    base = m.filter(F.col(group) == reference).select(F.col("n").alias("rn"), F.col("mean").alias("rmean"), F.col("var").alias("rvar"))
    rows = m.join(F.broadcast(base)).join(rank_statistics(df, group, value, reference), group, "left").join(chi_square(df, group, value, reference, low, high, bins), group, "left")  # base: one row

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                there = lambda *names: all(r[n] is not None and r[n] == r[n] for n in names)  # noqa: B023, E731
                row = {group: r[group], "normality_p": special.normality_p(int(r["n"]), r["skew"], r["kurt"] + 3) if there("skew", "kurt") else math.nan}
                spread = r["var"] / r["n"] + r["rvar"] / r["rn"] if there("var", "rvar") and r["n"] > 1 and r["rn"] > 1 else 0.0
                other = r[group] != reference
                row["z_p"] = 2 * special.normal_sf(abs(r["mean"] - r["rmean"]) / math.sqrt(spread)) if other and spread > 0 else math.nan
                ranked = other and there("u", "ks")
                row["mann_whitney_p"] = special.mann_whitney_p(r["u"], int(r["n1"]), int(r["n2"]), r["ties"]) if ranked else math.nan
                row["ks_p"] = special.ks_sf(r["ks"], int(r["n1"]), int(r["n2"])) if ranked else math.nan
                row["chi_square_p"] = special.chi2_sf(r["chi2"], int(r["dof"])) if there("chi2", "dof") else math.nan
                out.append(row)
            yield pd.DataFrame(out, columns=[group, "normality_p", "z_p", "mann_whitney_p", "ks_p", "chi_square_p"])

    return rows.mapInPandas(judge, f"{group} string, {_TESTS}")
