"""Mass cytometry: channel names, leakage pairs, bead windows, time bins and drift factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytora.functions.exprs import arcsinh, fin
from cytora.operators import ordered, stats
from cytora.session import materialise

#: Name of a mass channel: element and mass in either order, with an optional suffix.
MASS_NAME = r"(?i)^(?:([A-Za-z]{1,2})(\d{2,3})|(\d{2,3})([A-Za-z]{1,2}))(?:D[id])?$"


def mass_of(name: Column) -> tuple[Column, Column]:
    """(element, mass) of a channel name; null for other names."""
    get = lambda i: F.regexp_extract(name, MASS_NAME, i)
    ok = name.rlike(MASS_NAME)
    return F.when(ok, F.initcap(F.concat(get(1), get(4)))), F.when(ok, F.concat(get(2), get(3)).cast("int"))


def leakage_pairs(channels: DataFrame) -> DataFrame:
    """(source, receiver, reason) of mass channels: neighbouring masses, oxides (+16) and isotopes of one element.

    Pairs are found by equality joins on the masses a source can leak into, not by comparing all with all.
    """
    one = channels.select(F.col("name").alias("source"), F.col("mass").alias("m"), F.col("element").alias("e"))
    two = channels.select(F.col("name").alias("receiver"), F.col("mass").alias("rm"), F.col("element").alias("re"))
    shifts = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r).alias("r")) for k, r in ((-1, "abundance"), (1, "abundance"), (16, "oxide"))])
    near = one.select("source", "m", "e", F.explode(shifts).alias("s")).withColumn("rm", F.col("m") + F.col("s.k")).join(two, "rm").select("source", "receiver", F.col("s.r").alias("reason"))
    same = one.join(two, one.e == two["re"]).filter("m != rm").select("source", "receiver", F.lit("isotope").alias("reason"))
    return near.unionByName(same).filter("source != receiver").groupBy("source", "receiver").agg(F.concat_ws("+", F.array_sort(F.collect_set("reason"))).alias("reason"))


def isotope_window(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, low, high): the upper end of a channel mirrored around the median of its upper half."""
    good = df.filter(fin(F.col(value))).select(group, value)
    top = good.groupBy(group).agg(F.max(value).alias("high"))
    upper = good.join(top, group).filter(F.col(value) >= F.col("high") / 2)
    median = stats.exact_quantiles(upper, [group, "high"], [value], [0.5])
    return median.select(group, (2 * F.col("q")[0] - F.col("high")).alias("low"), "high")


def widest_gap(df: DataFrame, group: str, value: str, cofactor: float = 5.0) -> DataFrame:
    """(group, boundary): middle of the widest interval without values, above the lowest 5 % and below the highest 1 %.

    Equal values are counted together first, so the ordered pass runs over distinct values.
    """
    x = arcsinh(F.col(value).cast("double") / cofactor)
    grouped = df.filter(fin(F.col(value))).select(F.col(group), x.alias("_x")).groupBy(group, "_x").agg(F.count(F.lit(1)).alias("_n"))
    rows = ordered.scan(grouped, ["_x"], {"_n": "_upto"}, {"_x": "_before"}, group)
    ends = rows.groupBy(group).agg(F.max("_upto").alias("_all"))
    gap = rows.join(ends, group).withColumns({"_below": F.col("_upto") - F.col("_n"), "_gap": F.col("_x") - F.col("_before"), "_h": 0.25 * (F.col("_all") - 1)})
    at = lambda r: F.max(F.when((F.col("_below") <= r(F.col("_h"))) & (r(F.col("_h")) < F.col("_upto")), F.col("_x")))  # noqa: E731  the value of a rank
    part = F.max(F.col("_h") - F.floor(F.col("_h")))
    quarter = ((1 - part) * at(F.floor) + part * at(F.ceil)).alias("_q")
    held = (F.col("_below") >= F.greatest(F.lit(2), F.ceil(F.col("_all") * 0.05))) & (F.col("_all") - F.col("_below") >= F.greatest(F.lit(1), F.ceil(F.col("_all") * 0.01)))
    best = gap.groupBy(group).agg(F.max_by(F.struct(F.col("_gap").alias("g"), ((F.col("_x") + F.col("_before")) / 2).alias("m")), F.when(held & (F.col("_gap") > 0), F.struct(F.col("_gap"), -F.col("_x")))).alias("b"), quarter)
    return best.select(group, (F.lit(cofactor) * F.sinh(F.coalesce(F.col("b.m"), F.col("_q")))).alias("boundary"))


def bead_bins(total: Column, per_bin: int = 50) -> Column:
    """Size of equal-count time bins for so many beads."""
    bins = F.greatest(F.lit(2), F.bround(total / float(per_bin)).cast("long"))
    bins = F.least(F.lit(200), F.least(bins, F.greatest(F.lit(2), F.floor(total / 10))))
    return F.ceil(total / bins)


def time_bins(df: DataFrame, sample: str, time: str, values: list[str], order: list[str]) -> DataFrame:
    """(sample, bin, n, time, values...): medians of equally filled time bins; a last bin of fewer than 25 joins the one before."""
    needed = list(dict.fromkeys([sample, time, *values, *order]))
    indexed = ordered.row_index(df.filter(fin(F.col(time))).select(*needed), [time, *order], "_i", sample, "_n")
    rows = indexed.filter("_n >= 20").withColumn("_size", bead_bins(F.col("_n"))).withColumn("bin", F.floor(F.col("_i") / F.col("_size")))
    last = F.floor((F.col("_n") - 1) / F.col("_size"))
    short = (F.col("_n") - last * F.col("_size") < 25) & (last > 0)
    halves = F.when(F.col("_i") >= F.floor(F.col("_n") / 2), 1).otherwise(0)  # where only one bin would be left
    merged = rows.withColumn("bin", F.when(short & (last == 1), halves).when(short & (F.col("bin") == last), last - 1).otherwise(F.col("bin")).cast("int"))
    sizes = merged.groupBy(sample, "bin").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(stats.exact_medians(merged, [sample, "bin"], [time, *values]), [sample, "bin"])


def interpolated(knots: list[tuple[float, float]], x: Column) -> Column:
    """Piecewise linear value between knots, flat beyond the ends: an as-of lookup without a join."""
    k = sorted(knots)
    out = F.lit(float(k[-1][1]))
    for (ax, ay), (bx, by) in reversed(list(zip(k, k[1:]))):
        if bx > ax:
            out = F.when(x < bx, F.lit(float(ay)) + (x - float(ax)) * ((by - ay) / (bx - ax))).otherwise(out)
    return F.when(x <= k[0][0], F.lit(float(k[0][1]))).otherwise(out)


#: Knots of a piece, within which an event looks for its neighbours.
PIECE = 64


def _place(x: Column, v: Column, most: int) -> Column:
    """Place of the last entry of a sorted array of at most ``most`` that doesn't exceed ``v``, 0 if all do: by bisection."""
    jumps = [1 << b for b in reversed(range(max(1, int(most - 1).bit_length())))]
    found = F.aggregate(F.array(*[F.lit(j) for j in jumps]), F.lit(0), lambda p, j: F.when((p + j < F.size(x)) & (v >= F.get(x, p + j)), p + j).otherwise(p))
    return F.when(F.size(x) <= 1, 0).otherwise(found)


def asof_interpolate(df: DataFrame, knots: DataFrame, keys: list[str], x: str, kx: str, ky: str | list[str], out: str | list[str]) -> DataFrame:
    """Adds the values interpolated between the neighbouring knots of the same keys, flat beyond the ends; null without knots.

    Knots are cut into pieces of ``PIECE`` by their rank, so that knots that lie closely fill pieces as others do. An event finds its
    piece among the first knots of all pieces of its keys, and its neighbours within the piece: two equality joins,
    whatever the number of knots; a hot key is spread by its pieces. Several values at the same knots come from one pass.
    """
    kys, outs = ([ky], [out]) if isinstance(ky, str) else (ky, out)
    values = [f"_y{i}" for i in range(len(kys))]
    base = knots.select(*keys, F.col(kx).cast("double").alias("_x"), *[F.col(c).cast("double").alias(n) for c, n in zip(kys, values)]).filter(fin(F.col("_x")))
    w = Window.partitionBy(*keys).orderBy("_x")
    ranked = base.withColumns({"_piece": F.floor((F.row_number().over(w) - 1) / PIECE).cast("int"), **{f"_n{c}": F.lead(c).over(w) for c in ("_x", *values)}})
    pieces = ranked.groupBy(*keys, "_piece").agg(F.array_sort(F.collect_list(F.struct("_x", *values, *[f"_n{c}" for c in ("_x", *values)]))).alias("_k"))
    pieces = materialise(pieces.withColumn("_kx", F.transform("_k", lambda k: k["_x"])))  # knots only
    tops = pieces.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_piece", F.get("_kx", F.lit(0)).alias("_x")))), lambda s: s["_x"]).alias("_tops"))
    most = 1 << 24  # pieces of a key that bisection is prepared for: a thousand million knots
    rows = df.join(tops, keys, "left").withColumn("_v", F.col(x).cast("double"))
    rows = rows.withColumn("_piece", F.when(F.col("_v").isNotNull(), _place(F.col("_tops"), F.col("_v"), most)))
    hit = rows.join(pieces, [*keys, "_piece"], "left")
    hit = hit.withColumn("_at", _place(F.col("_kx"), F.col("_v"), PIECE)).withColumn("_one", F.get("_k", F.col("_at")))
    one = F.col("_one")
    part = (F.col("_v") - one["_x"]) / F.nullif(one["_n_x"] - one["_x"], F.lit(0.0))
    flat = (F.col("_v") <= one["_x"]) | one["_n_x"].isNull()
    added = {o: F.when(flat, one[c]).otherwise(one[c] + (one[f"_n{c}"] - one[c]) * F.col("_part")) for o, c in zip(outs, values)}
    return hit.withColumn("_part", part).withColumns(added).drop("_tops", "_v", "_piece", "_k", "_kx", "_at", "_one", "_part")
