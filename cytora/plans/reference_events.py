"""Gates, statistics, scales, matrices and histograms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytora.functions import exprs as X
from cytora.functions.exprs import f32
from cytora.operators import hist, linalg, platforms, stats
from cytora.plans import gates as G
from cytora.plans.adapters import ITEMS_SQL, P_ASINH, P_LOG, D, P, Q, items, norm_sql
from cytora.plans.gates import Gate, GateTree, Kind, Operand
from cytora.plans.reference import query
from cytora.session import table

r6 = lambda c: F.round(c, 6)
r4 = lambda c: F.round(c, 4)


# --- gates -----------------------------------------------------------------------------------------------------


def _counts(tree: GateTree):
    def run(spark, d: str) -> DataFrame:
        rows = G.counts(items(spark, d), tree, "sample_id")
        return rows.select("sample_id", "population", "n_events", r6(F.col("freq_of_parent")).alias("freq_of_parent"), r6(F.col("freq_of_all")).alias("freq_of_all"))

    return run


def _counts_sql(masks: dict[str, str], up: dict[str, str | None] | None = None) -> str:
    """The same counts in SQL: masks by population over q, p, d, t and their normalised forms."""
    names = list(masks)
    cols = ", ".join(f"sum(CASE WHEN {masks[n]} THEN 1 ELSE 0 END) AS m{i}" for i, n in enumerate(names))
    norm = ", ".join(f"{norm_sql(c, a)} AS n{c}" for c, a in (("q", Q), ("p", P), ("d", D))) + f", {norm_sql('p', P_LOG)} AS nl, {norm_sql('p', P_ASINH)} AS na"
    share = "round(CASE WHEN {of} > 0 THEN 100.0 * {n} / {of} ELSE 0.0 END, 6)"
    parts = []
    for i, n in enumerate(names):
        of = "total" if not up or up.get(n) is None else f"m{names.index(up[n])}"
        parts.append(f"SELECT sample_id, '{n}' AS population, CAST(m{i} AS BIGINT) AS n_events, {share.format(n=f'm{i}', of=of)} AS freq_of_parent, {share.format(n=f'm{i}', of='total')} AS freq_of_all FROM s")
    return f"WITH {ITEMS_SQL}, nv AS (SELECT *, {norm} FROM ev), s AS (SELECT sample_id, count(*) AS total, {cols} FROM nv GROUP BY sample_id) " + " UNION ALL ".join(parts)


def _polygon_sql(points: list[tuple[float, float]], x: str, y: str) -> str:
    parts = []
    for (ax, ay), (bx, by) in zip(points, [*points[-1:], *points[:-1]]):
        if ay != by:
            parts.append(f"CASE WHEN ({ay!r} > {y}) <> ({by!r} > {y}) AND {x} < {bx - ax!r} * ({y} - {ay!r}) / {by - ay!r} + {ax!r} THEN 1 ELSE 0 END")
    return f"(({' + '.join(parts)}) % 2 = 1)"


_HEX = ((5.0, 8000.0), (20.0, 4000.0), (44.0, 30000.0), (40.0, 80000.0), (22.0, 60000.0), (8.0, 30000.0))
_POINTS = [(Q.normalised_number(a), P.normalised_number(b)) for a, b in _HEX]
_POINTS_LOG = [(Q.normalised_number(a), P_LOG.normalised_number(b)) for a, b in _HEX]
query(_counts_sql({"hex": _polygon_sql(_POINTS, "nq", "np"), "hexlog": _polygon_sql(_POINTS_LOG, "nq", "nl")}), "gate_polygon")(
    _counts(GateTree().add(Gate("hex", Kind.POLYGON, "q", "p", _HEX, Q, P)).add(Gate("hexlog", Kind.POLYGON, "q", "p", _HEX, Q, P_LOG)))
)

_N = lambda a, v: repr(a.normalised_number(v))
query(_counts_sql({"box": f"nq >= {_N(Q, 10)} AND nq <= {_N(Q, 30)} AND np >= {_N(P, 5000)} AND np <= {_N(P, 40000)}"}), "gate_rectangle")(
    _counts(GateTree().add(Gate("box", Kind.RECTANGLE, "q", "p", ((30, 5000), (10, 40000)), Q, P)))
)
query(_counts_sql({"cut:More": f"nq >= {_N(Q, 35)}", "cut:Less": f"NOT nq >= {_N(Q, 35)}"}), "gate_threshold")(_counts(GateTree().add(Gate("cut", Kind.THRESHOLD, "q", "", ((35, 0),), Q))))
query(
    _counts_sql({"mid:InRange": f"nd >= {_N(D, 0.03)} AND nd <= {_N(D, 0.07)}", "mid:BelowRange": f"nd < {_N(D, 0.03)}", "mid:AboveRange": f"nd > {_N(D, 0.07)}"}), "gate_range"
)(_counts(GateTree().add(Gate("mid", Kind.RANGE, "d", "", ((0.07, 0), (0.03, 0)), D))))
_quad = {
    "TopRight": "{x} >= {cx} AND {y} >= {cy}", "TopLeft": "{x} < {cx} AND {y} >= {cy}",
    "BottomRight": "{x} >= {lx} AND {y} < {cy}", "BottomLeft": "{x} < {lx} AND {y} < {cy}",
}
query(_counts_sql({f"quad:{r}": t.format(x="nq", y="na", cx=_N(Q, 25), lx=_N(Q, 25), cy=_N(P_ASINH, 30000)) for r, t in _quad.items()}), "gate_quadrant")(
    _counts(GateTree().add(Gate("quad", Kind.QUADRANT, "q", "p", ((25, 30000),), Q, P_ASINH)))
)
query(_counts_sql({f"off:{r}": t.format(x="nq", y="np", cx=_N(Q, 20), lx=_N(Q, 33), cy=_N(P, 30000)) for r, t in _quad.items()}), "gate_offset_quadrant")(
    _counts(GateTree().add(Gate("off", Kind.OFFSET, "q", "p", ((25, 30000), (20, 0), (33, 0)), Q, P)))
)
_bx, _by = "exp(0.1 * (ln(greatest(p, 1e-6)) - ln(30000.0)) + ln(25.0))", "exp(0.1 * (ln(greatest(q, 1e-6)) - ln(25.0)) + ln(30000.0))"
query(
    _counts_sql({
        "curl:TopRight": f"q >= (CASE WHEN p >= 30000 THEN {_bx} ELSE 25.0 END) AND p >= (CASE WHEN q >= 25 THEN {_by} ELSE 30000.0 END)",
        "curl:TopLeft": f"p >= 30000 AND q < {_bx}", "curl:BottomRight": f"q >= 25 AND p < {_by}", "curl:BottomLeft": "q < 25 AND p < 30000",
    }),
    "gate_curly",
)(_counts(GateTree().add(Gate("curl", Kind.CURLY, "q", "p", ((25, 30000),)))))

_A, _B = f"nq >= {_N(Q, 20)}", f"nd <= {_N(D, 0.05)} AND nd >= {_N(D, 0.0)}"
for _key, _kind, _sql in (("gate_merge", Kind.MERGE, f"(({_A}) OR ({_B}))"), ("gate_exclude", Kind.EXCLUDE, f"(({_A}) AND NOT ({_B}))"), ("gate_overlap", Kind.OVERLAP, f"(({_A}) AND ({_B}))")):
    _tree = GateTree().add(Gate("a", Kind.THRESHOLD, "q", "", ((20, 0),), Q)).add(Gate("b", Kind.RANGE, "d", "", ((0, 0), (0.05, 0)), D))
    _tree.add(Gate("both", _kind, first=Operand("a", "More"), second=Operand("b", "InRange")))
    query(
        _counts_sql({"a:More": _A, "a:Less": f"NOT ({_A})", "b:InRange": _B, "b:BelowRange": f"nd < {_N(D, 0.0)}", "b:AboveRange": f"nd > {_N(D, 0.05)}", "both": _sql}), _key
    )(_counts(_tree))

TREE = (
    GateTree()
    .add(Gate("parent", Kind.THRESHOLD, "q", "", ((35, 0),), Q))
    .add(Gate("child", Kind.POLYGON, "q", "p", ((36, 20000), (49, 20000), (49, 90000), (36, 70000)), Q, P, "parent", "More"))
    .add(Gate("deep", Kind.RECTANGLE, "d", "p", ((0.02, 0), (0.08, 60000)), D, P, "child"))
)
_child = _polygon_sql([(Q.normalised_number(a), P.normalised_number(b)) for a, b in ((36, 20000), (49, 20000), (49, 90000), (36, 70000))], "nq", "np")
_more = f"nq >= {_N(Q, 35)}"
_deep = f"nd >= {_N(D, 0.02)} AND nd <= {_N(D, 0.08)} AND np >= {_N(P, 0)} AND np <= {_N(P, 60000)}"
query(
    _counts_sql({"parent:More": _more, "parent:Less": f"NOT {_more}", "child": f"{_more} AND {_child}", "deep": f"{_more} AND {_child} AND {_deep}"}, {"child": "parent:More", "deep": "child"}),
    "gate_hierarchy",
)(_counts(TREE))


@query(f"WITH {ITEMS_SQL}, n AS (SELECT sample_id, batch, {norm_sql('q', Q)} AS nq FROM ev), s AS (SELECT sample_id, batch, count(*) AS total, sum(CASE WHEN nq >= {_N(Q, 35)} THEN 1 ELSE 0 END) AS n FROM n GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS n_events, round(avg(100.0 * n / total), 6) AS mean_freq, CAST(count(*) AS BIGINT) AS n_samples FROM s")
def gate_annotation(spark, d):
    """Events of a population over all samples, and the mean of its share per sample."""
    tree = GateTree().add(Gate("cut", Kind.THRESHOLD, "q", "", ((35, 0),), Q))
    rows = items(spark, d).withColumn("sample", F.concat_ws("/", "sample_id", "batch"))
    per = G.counts(rows, tree, "sample").filter("population = 'cut:More'")
    return per.agg(F.sum("n_events").alias("n_events"), r6(F.avg("freq_of_parent")).alias("mean_freq"), F.count(F.lit(1)).alias("n_samples"))


# --- statistics ------------------------------------------------------------------------------------------------

_POP = f"nq >= {_N(Q, 35)}"


def _pop(spark, d):
    mask = G.compile_tree(GateTree().add(Gate("cut", Kind.THRESHOLD, "q", "", ((35, 0),), Q)), ["q"])["cut:More"]
    return items(spark, d).withColumn("_in", mask)


def _stat_sql(expr: str, name: str = "value") -> str:
    return f"WITH {ITEMS_SQL}, nv AS (SELECT *, {norm_sql('q', Q)} AS nq FROM ev) SELECT sample_id, {expr} AS {name} FROM nv GROUP BY sample_id"


@query(_stat_sql(f"CAST(sum(CASE WHEN {_POP} THEN 1 ELSE 0 END) AS BIGINT)"))
def stat_count(spark, d):
    return _pop(spark, d).groupBy("sample_id").agg(F.sum(F.col("_in").cast("long")).alias("value"))


@query(_stat_sql(f"round(100.0 * sum(CASE WHEN {_POP} THEN 1 ELSE 0 END) / count(*), 6)"))
def stat_freq_parent(spark, d):
    return _pop(spark, d).groupBy("sample_id").agg(r6(100.0 * F.sum(F.col("_in").cast("long")) / F.count(F.lit(1))).alias("value"))


@query(_stat_sql(f"round(100.0 * sum(CASE WHEN {_POP} AND d <= 0.05 THEN 1 ELSE 0 END) / count(*), 6)"))
def stat_freq_all(spark, d):
    inside = F.col("_in") & X.at_most(F.col("d"), 0.05)
    return _pop(spark, d).groupBy("sample_id").agg(r6(100.0 * F.sum(inside.cast("long")) / F.count(F.lit(1))).alias("value"))


_V = f"CASE WHEN {_POP} THEN p END"
for _key, _stat, _sql in (
    ("stat_mean", "Mean", f"round(coalesce(avg({_V}), 0), 4)"),
    ("stat_median", "Median", f"round(coalesce(quantile_cont({_V}, 0.5), 0), 4)"),
    ("stat_geomean", "GeometricMean", f"round(coalesce(exp(avg(ln({_V}))), 0), 4)"),
    ("stat_sd", "StandardDeviation", f"round(coalesce(stddev_samp({_V}), 0), 4)"),
    ("stat_cv", "CV", f"round(coalesce(100.0 * stddev_samp({_V}) / avg({_V}), 0), 4)"),
):

    def _run(spark, d, stat=_stat):
        if stat == "Median":
            medians = stats.exact_medians(_pop(spark, d).filter("_in"), ["sample_id"], ["p"])
            everyone = items(spark, d).select("sample_id").distinct()  # an empty population has a median of 0
            return everyone.join(medians, "sample_id", "left").select("sample_id", r4(F.coalesce("p", F.lit(0.0))).alias("value"))
        value = stats.kept(F.col("p"), F.col("_in"))
        return _pop(spark, d).groupBy("sample_id").agg(r4(stats.NATIVE[stat](value)).alias("value"))

    query(_stat_sql(_sql), _key)(_run)


@query(f"WITH {ITEMS_SQL}, r AS (SELECT sample_id, p, row_number() OVER (PARTITION BY sample_id ORDER BY p DESC) AS k FROM ev) SELECT sample_id, coalesce(max(CASE WHEN k = 51 THEN p END), max(p)) AS robust_max FROM r WHERE k <= 51 GROUP BY sample_id")
def robust_max(spark, d):
    return stats.robust_maximum(items(spark, d), "sample_id", "p")


@query(f"WITH {ITEMS_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS channel, min({c}) AS low, max({c}) AS high FROM ev" for c in "qpdt"))
def channel_range(spark, d):
    rows = items(spark, d).agg(*[f(stats.kept(F.col(c))).alias(f"{n}_{c}") for c in "qpdt" for n, f in (("low", F.min), ("high", F.max))])
    return rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"low_{c}").alias("low"), F.col(f"high_{c}").alias("high")) for c in "qpdt"])))


def _axis_sql(kind: str, column: str, cap: float) -> str:
    lo, hi = f"min({column})", f"max({column})"
    if kind == "time":
        return f"SELECT 'time' AS axis, greatest(floor({lo} / 100) * 100.0, {-0.01 * cap!r}) AS low, least(CASE WHEN {hi} > {lo} THEN ceil({hi} / 100) * 100.0 ELSE greatest(floor({lo} / 100) * 100.0, {-0.01 * cap!r}) + 1e-6 END, {cap!r}) AS high FROM ev"
    u, o = (0.1, 1.1) if kind == "linear" else (0.01, 3.0)
    return f"SELECT '{kind}' AS axis, greatest(greatest(floor({-u!r} * greatest({hi}, 1e-6) / 100) * 100.0, {-0.01 * cap!r}), floor({lo} / 100) * 100.0) AS low, least(ceil({o!r} * greatest({hi}, 1e-6) / 100) * 100.0, {cap!r}) AS high FROM ev"


@query(f"WITH {ITEMS_SQL} " + " UNION ALL ".join(_axis_sql(k, "p", 262144.0) for k in ("time", "linear", "logicle")))
def data_implied_axis(spark, d):
    ends = items(spark, d).agg(F.min(stats.kept(F.col("p"))).alias("lo"), F.max(stats.kept(F.col("p"))).alias("hi"))
    rows = []
    for kind in ("time", "linear", "logicle"):
        low, high = stats.implied_axis(F.col("lo"), F.col("hi"), kind, 262144.0)
        rows.append(F.struct(F.lit(kind).alias("axis"), low.alias("low"), high.alias("high")))
    return ends.select(F.inline(F.array(*rows)))


@query(f"WITH {ITEMS_SQL} SELECT sample_id, round(avg(p) / 1000.0, 6) AS value FROM ev GROUP BY sample_id")
def udaf_python(spark, d):
    """A user's function over each sample's matrix."""
    rows = stats.python_statistic(items(spark, d), "sample_id", ["q", "p"], lambda m, names, par: m[:, names.index("p")].astype(float).mean() / par["unit"], {"unit": 1000.0})
    return rows.select("sample_id", r6(F.col("value")).alias("value"))


# --- scales ----------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS id, round(sign(x) * log10(1 + abs(x)), 6) AS y, round(x, 2) AS back FROM (SELECT c_custkey, CAST(CAST(c_acctbal AS FLOAT) AS DOUBLE) AS x FROM customer)")
def scale_signed_log(spark, d):
    x = f32(F.col("c_acctbal"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), r6(X.signed_log(x)).alias("y"), F.round(X.signed_log_inverse(X.signed_log(x)), 2).alias("back"))


@query("SELECT c_custkey AS id, round(asinh(x / 5), 6) AS y, round(x, 2) AS back FROM (SELECT c_custkey, CAST(CAST(c_acctbal AS FLOAT) AS DOUBLE) AS x FROM customer)")
def scale_arcsinh(spark, d):
    x = f32(F.col("c_acctbal"))
    y = X.arcsinh(x / 5)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), r6(y).alias("y"), F.round(5 * F.sinh(y), 2).alias("back"))


@query("SELECT c_custkey AS id, round(CAST(CAST(c_acctbal AS FLOAT) AS DOUBLE), 4) AS back FROM customer")
def scale_logicle_roundtrip(spark, d):
    scale = X.Logicle()
    there = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), X.logicle(f32(F.col("c_acctbal")), scale).alias("y"))
    return there.select("id", r4(scale.inverse(F.col("y"))).alias("back"))


@query(f"WITH {ITEMS_SQL} SELECT sample_id, round(sum({norm_sql('q', Q)}), 4) AS q, round(sum({norm_sql('p', P_LOG)}), 4) AS p_log, round(sum({norm_sql('p', P_ASINH)}), 4) AS p_arcsinh FROM ev GROUP BY sample_id")
def normalized_axis(spark, d):
    return items(spark, d).groupBy("sample_id").agg(*[r4(F.sum(a.normalised(F.col(c)))).alias(n) for n, a, c in (("q", Q, "q"), ("p_log", P_LOG, "p"), ("p_arcsinh", P_ASINH, "p"))])


def _logicle_sql() -> str:
    """Forward values by halving the interval in which the closed inverse reaches the value."""
    k = X.Logicle().constants()
    inverse = f"({k['a']!r} * exp({k['b']!r} * m) - {k['c']!r} * exp({-k['d']!r} * m) - {k['f']!r})"
    return f"""WITH RECURSIVE x AS (SELECT c_custkey AS id, CAST(CAST(c_acctbal AS FLOAT) AS DOUBLE) AS v FROM customer),
s(id, v, lo, hi, step) AS (SELECT id, v, {k['x1']!r}::DOUBLE, 2.0::DOUBLE, 0 FROM x UNION ALL SELECT id, v, CASE WHEN {inverse} < abs(v) THEN m ELSE lo END, CASE WHEN {inverse} < abs(v) THEN hi ELSE m END, step + 1 FROM (SELECT *, (lo + hi) / 2 AS m FROM s) WHERE step < 60)
SELECT id, round(CASE WHEN v < 0 THEN 2 * {k['x1']!r} - lo ELSE lo END, 9) AS y FROM s WHERE step = 60"""


@query(_logicle_sql())
def scale_logicle(spark, d):
    """Positions of data values on the biexponential scale."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.round(X.logicle(f32(F.col("c_acctbal")), X.Logicle()), 9).alias("y"))


@query(f"WITH {ITEMS_SQL}, m AS (SELECT avg(p) AS mu, stddev_samp(p) AS sd FROM ev) SELECT sample_id, round(avg(CAST(CAST((p - mu) / sd AS FLOAT) AS DOUBLE)), 5) AS mean_z, round(max(CAST(CAST((p - mu) / sd AS FLOAT) AS DOUBLE)), 5) AS max_z FROM ev, m GROUP BY sample_id")
def zscore_linear(spark, d):
    rows = platforms.scaled(items(spark, d), ["p"])
    z = F.col("p").cast("double")
    return rows.groupBy("sample_id").agg(F.round(F.avg(z), 5).alias("mean_z"), F.round(F.max(z), 5).alias("max_z"))


@query("SELECT s_suppkey AS id, round(CASE WHEN x <= 0 THEN 0 WHEN x <= 1000 THEN x / 1000 ELSE 1 + log10(x / 1000) END, 6) AS y FROM (SELECT s_suppkey, CAST(CAST(s_acctbal AS FLOAT) AS DOUBLE) AS x FROM supplier)")
def spectral_display(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), r6(X.spectral_display(f32(F.col("s_acctbal")))).alias("y"))


# --- matrices --------------------------------------------------------------------------------------------------

_M2 = np.array([[1.0, 0.002], [15.0, 1.0]])
_M4 = np.array([[1, 0.001, 0.0002, 0.0001], [2.0, 1, 0.0001, 0.0002], [0.5, 0.3, 1, 0.02], [0.1, 0.2, 0.05, 1]], dtype=float)


def _comp_sql(channels: str, m: np.ndarray) -> str:
    inv = linalg.inverse(m)
    cols = ", ".join(f"round(sum(CAST(CAST({' + '.join(f'{c} * {float(inv[i, j])!r}' for i, c in enumerate(channels))} AS FLOAT) AS DOUBLE)), 1) AS {t}_comp" for j, t in enumerate(channels))
    return f"WITH {ITEMS_SQL} SELECT sample_id, {cols} FROM ev GROUP BY sample_id"


def _comp(channels: str, m: np.ndarray):
    def run(spark, d):
        rows = linalg.compensated(items(spark, d), list(channels), m, "_comp")
        return rows.groupBy("sample_id").agg(*[F.round(F.sum(F.col(f"{c}_comp").cast("double")), 1).alias(f"{c}_comp") for c in channels])

    return run


query(_comp_sql("qp", _M2), "compensate_2ch")(_comp("qp", _M2))
query(_comp_sql("qpdt", _M4), "compensate_4ch")(_comp("qpdt", _M4))

_COEF = {f"mol{k}": [round(float(np.sin(1 + k + j * (k + 1))), 6) for j in range(64)] for k in range(3)}


@query("SELECT vec_id, " + ", ".join(f"round(CAST(CAST({' + '.join(f'CAST(embedding[{j + 1}] AS DOUBLE) * {w!r}' for j, w in enumerate(ws))} AS FLOAT) AS DOUBLE), 4) AS {n}" for n, ws in _COEF.items()) + " FROM embeddings")
def unmix_apply(spark, d):
    rows = table(spark, d, "embeddings")
    return rows.select("vec_id", *[F.round(c.cast("double"), 4).alias(n) for n, c in linalg.unmixed("embedding", _COEF).items()])


@query("WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, range(1, 65) t(i) GROUP BY label, i) SELECT CAST(a.label AS INTEGER) AS a, CAST(b.label AS INTEGER) AS b, round(sum(a.v * b.v) / sqrt((sum(a.v * a.v) + 1e-9) * (sum(b.v * b.v) + 1e-9)), 6) AS similarity FROM m a JOIN m b ON a.i = b.i AND a.label < b.label GROUP BY ALL")
def cosine_similarity(spark, d):
    """Cosine between the mean signatures of the labels; the pairs are those of a handful of signatures, keyed by detector."""
    m = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    a, b = m.select(F.col("label").alias("a"), "i", F.col("v").alias("va")), m.select(F.col("label").alias("b"), "i", F.col("v").alias("vb"))
    pairs = a.join(b, "i").filter("a < b").groupBy("a", "b")
    dot, na, nb = F.sum(F.col("va") * F.col("vb")), F.sum(F.col("va") * F.col("va")), F.sum(F.col("vb") * F.col("vb"))
    return pairs.agg(r6(dot / F.sqrt((na + 1e-9) * (nb + 1e-9))).alias("similarity"))


@query(f"WITH {ITEMS_SQL} " + " UNION ALL ".join(f"SELECT sample_id, '{a}' AS primary_channel, '{b}' AS detector, round(regr_slope({b}, {a}), 6) AS slope FROM ev WHERE q >= 10 GROUP BY sample_id" for a in "qpd" for b in "qpd" if a != b))
def spillover_slopes(spark, d):
    """Slope of every detector over every primary channel on the events inside the gate of each control."""
    rows = items(spark, d).filter(X.at_least(F.col("q"), 10.0))
    pairs = [(a, b) for a in "qpd" for b in "qpd" if a != b]
    sums = rows.groupBy("sample_id").agg(*[F.regr_slope(b, a).alias(f"{a}_{b}") for a, b in pairs])
    return sums.select("sample_id", F.inline(F.array(*[F.struct(F.lit(a).alias("primary_channel"), F.lit(b).alias("detector"), r6(F.col(f"{a}_{b}")).alias("slope")) for a, b in pairs])))


@query(f"WITH {ITEMS_SQL} SELECT sample_id, round(regr_slope(p, q), 4) AS slope, round(regr_intercept(p, q), 2) AS intercept FROM ev GROUP BY sample_id")
def ols_slope(spark, d):
    return items(spark, d).groupBy("sample_id").agg(r4(F.regr_slope("p", "q")).alias("slope"), F.round(F.regr_intercept("p", "q"), 2).alias("intercept"))


# --- histograms ------------------------------------------------------------------------------------------------

_FIT = f"CASE WHEN floor((p - 0) / 110000.0 * 500) BETWEEN 0 AND 499 THEN CAST(floor((p - 0) / 110000.0 * 500) AS INTEGER) END"


@query(f"WITH {ITEMS_SQL}, b AS (SELECT sample_id, {_FIT} AS bin FROM ev), h AS (SELECT sample_id, bin, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY sample_id, bin), g AS (SELECT DISTINCT sample_id FROM h) SELECT g.sample_id, CAST(i AS INTEGER) AS bin, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY g.sample_id), 9) AS share FROM g CROSS JOIN range(500) t(i) LEFT JOIN h ON h.sample_id = g.sample_id AND h.bin = i")
def histogram_500(spark, d):
    h = hist.dense(hist.counted(items(spark, d), ["sample_id"], hist.fit_bin(F.col("p"), 0.0, 110000.0, 500)), ["sample_id"], 500)
    return hist.shares(h, ["sample_id"]).select("sample_id", "bin", F.round("share", 9).alias("share"))


@query(f"WITH {ITEMS_SQL}, n AS (SELECT sample_id, {norm_sql('p', P)} AS x FROM ev) SELECT sample_id, CAST(floor(x * 299) AS INTEGER) AS bin, count(*) AS n FROM n WHERE x BETWEEN 0 AND 1 GROUP BY ALL")
def plot_hist_300(spark, d):
    return hist.counted(items(spark, d), ["sample_id"], hist.plot_bin(P.normalised(F.col("p")), 300))


@query(f"WITH {ITEMS_SQL}, n AS (SELECT sample_id, {norm_sql('q', Q)} AS x FROM ev), h AS (SELECT sample_id, CAST(least(floor(x * 40), 39) AS INTEGER) AS bin, count(*) AS n FROM n WHERE x BETWEEN 0 AND 1 GROUP BY ALL) SELECT sample_id, bin, round(n / max(n) OVER (PARTITION BY sample_id), 9) AS height FROM h")
def display_hist(spark, d):
    h = hist.counted(items(spark, d), ["sample_id"], hist.display_bin(Q.normalised(F.col("q")), 40))
    return h.select("sample_id", "bin", F.round(F.col("n") / F.max("n").over(Window.partitionBy("sample_id")), 9).alias("height"))


_GRID = f"g AS (SELECT CAST(floor({norm_sql('q', Q)} * 299) AS INTEGER) AS xbin, CAST(floor({norm_sql('p', P)} * 299) AS INTEGER) AS ybin, * FROM ev WHERE {norm_sql('q', Q)} BETWEEN 0 AND 1 AND {norm_sql('p', P)} BETWEEN 0 AND 1)"


def _grid(spark, d, bins: int = 300):
    rows = items(spark, d).withColumns({"xbin": hist.plot_bin(Q.normalised(F.col("q")), bins), "ybin": hist.plot_bin(P.normalised(F.col("p")), bins)})
    return rows.filter("xbin IS NOT NULL AND ybin IS NOT NULL")


@query(f"WITH {ITEMS_SQL}, {_GRID} SELECT xbin, ybin, count(*) AS n FROM g GROUP BY ALL")
def density_grid(spark, d):
    return _grid(spark, d).groupBy("xbin", "ybin").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ITEMS_SQL}, {_GRID}, c AS (SELECT sample_id, xbin, ybin, count(*) AS n FROM g GROUP BY ALL) SELECT sample_id, xbin, ybin, round(ln(1 + n) / ln(1 + max(n) OVER (PARTITION BY sample_id)), 9) AS density FROM c")
def density_norm(spark, d):
    c = _grid(spark, d).groupBy("sample_id", "xbin", "ybin").agg(F.count(F.lit(1)).alias("n"))
    top = c.groupBy("sample_id").agg(F.max("n").alias("top"))
    return c.join(top, "sample_id").select("sample_id", "xbin", "ybin", F.round(F.ln(1.0 + F.col("n")) / F.ln(1.0 + F.col("top")), 9).alias("density"))


@query(f"WITH {ITEMS_SQL}, {_GRID}, c AS (SELECT xbin, ybin, sample_id, count(*) AS n, avg(log10(1 + greatest(d, 0))) AS v FROM g GROUP BY ALL) SELECT xbin, ybin, arg_min(sample_id, (-n, sample_id)) AS majority, round(sum(v * n) / sum(n), 9) AS mean_value FROM c GROUP BY ALL")
def density_mode(spark, d):
    """Majority label of each pixel (ties to the smaller label), and the mean of a continuous colour channel."""
    value = F.avg(F.log10(1 + F.greatest(F.col("d"), F.lit(0.0))))
    c = _grid(spark, d).groupBy("xbin", "ybin", "sample_id").agg(F.count(F.lit(1)).alias("n"), value.alias("v"))
    best = F.min_by("sample_id", F.struct(-F.col("n"), F.col("sample_id")))
    return c.groupBy("xbin", "ybin").agg(best.alias("majority"), F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 9).alias("mean_value"))


@query(f"WITH {ITEMS_SQL}, h AS (SELECT sample_id, CAST(floor(q) AS INTEGER) AS bin, count(*) AS n FROM ev GROUP BY ALL) SELECT sample_id, bin, round(avg(n) OVER (PARTITION BY sample_id ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smooth FROM h")
def moving_average(spark, d):
    h = hist.counted(items(spark, d), ["sample_id"], F.floor("q").cast("int"))
    return hist.moving_average(h, ["sample_id"], "bin", "n", 3).select("sample_id", "bin", r6(F.col("smooth")).alias("smooth"))


@query(f"WITH {ITEMS_SQL}, h AS (SELECT sample_id, CAST(least(floor(p / 110000.0 * 2048), 2047) AS INTEGER) AS bin, count(*) AS n FROM ev GROUP BY ALL), c AS (SELECT sample_id, bin, sum(n) OVER (PARTITION BY sample_id ORDER BY bin DESC) AS above FROM h) SELECT sample_id, max(bin) AS bin FROM c WHERE above >= 300 GROUP BY sample_id")
def top_threshold(spark, d):
    h = hist.counted(items(spark, d), ["sample_id"], F.least(F.floor(F.col("p") / 110000.0 * 2048), F.lit(2047)).cast("int"))
    above = h.withColumn("above", F.sum("n").over(Window.partitionBy("sample_id").orderBy(F.col("bin").desc())))
    return above.filter("above >= 300").groupBy("sample_id").agg(F.max("bin").alias("bin"))


def _blur_sql(size: int, passes: int) -> str:
    """Blur of the counts ``g`` (sample_id, xbin, ybin, n) along both axes, taps beyond a border left out."""
    steps, last = [f"b0 AS (SELECT s.sample_id, x.i AS xbin, y.i AS ybin, coalesce(g.n, 0)::DOUBLE AS v FROM (SELECT DISTINCT sample_id FROM g) s CROSS JOIN range({size}) x(i) CROSS JOIN range({size}) y(i) LEFT JOIN g ON g.sample_id = s.sample_id AND g.xbin = x.i AND g.ybin = y.i)"], "b0"
    taps = {-2: 1, -1: 4, 0: 6, 1: 4, 2: 1}
    for k in range(passes):
        for axis, other in (("ybin", "xbin"), ("xbin", "ybin")):
            at = lambda o: "v" if o == 0 else f"{'lag' if o < 0 else 'lead'}(v, {abs(o)}) OVER w"  # noqa: B023, E731
            top = " + ".join(f"{t} * coalesce({at(o)}, 0)" for o, t in taps.items())
            weight = " + ".join(f"CASE WHEN {axis} + {o} BETWEEN 0 AND {size - 1} THEN {t} ELSE 0 END" for o, t in taps.items())
            new = f"b{k}{axis[0]}"
            steps.append(f"{new} AS (SELECT sample_id, xbin, ybin, ({top}) / ({weight}) AS v FROM {last} WINDOW w AS (PARTITION BY sample_id, {other} ORDER BY {axis}))")
            last = new
    return ", ".join(steps) + f" SELECT sample_id, CAST(xbin AS INTEGER) AS xbin, CAST(ybin AS INTEGER) AS ybin, round(v, 6) AS density FROM {last} WHERE v > 1e-12"


_GRID_300 = f"g AS (SELECT sample_id, floor({norm_sql('q', Q)} * 299) AS xbin, floor({norm_sql('p', P)} * 299) AS ybin, count(*) AS n FROM ev WHERE {norm_sql('q', Q)} BETWEEN 0 AND 1 AND {norm_sql('p', P)} BETWEEN 0 AND 1 GROUP BY ALL)"


@query(f"WITH {ITEMS_SQL}, {_GRID_300}, {_blur_sql(300, 2)}")
def density_smooth(spark, d):
    """Blurred 300 x 300 density of every sample."""
    c = _grid(spark, d, 300).groupBy("sample_id", "xbin", "ybin").agg(F.count(F.lit(1)).alias("n"))
    return hist.smoothed_grid(c, ["sample_id"], 300, 2).withColumn("density", r6(F.col("density")))


def _smooth_sql(passes: int) -> str:
    steps = []
    for k in range(passes):
        w = "OVER (PARTITION BY sample_id ORDER BY bin)"
        steps.append(f"s{k + 1} AS (SELECT sample_id, bin, (2 * v + coalesce(lag(v) {w}, 0) + coalesce(lead(v) {w}, 0)) / (2 + CASE WHEN lag(v) {w} IS NULL THEN 0 ELSE 1 END + CASE WHEN lead(v) {w} IS NULL THEN 0 ELSE 1 END) AS v FROM s{k})")
    return ", ".join(steps)


@query(f"WITH {ITEMS_SQL}, h AS (SELECT sample_id, least(floor({norm_sql('q', Q)} * 50), 49) AS bin, count(*) AS n FROM ev WHERE {norm_sql('q', Q)} BETWEEN 0 AND 1 GROUP BY ALL), s0 AS (SELECT s.sample_id, CAST(b.i AS INTEGER) AS bin, coalesce(h.n, 0)::DOUBLE AS v FROM (SELECT DISTINCT sample_id FROM h) s CROSS JOIN range(50) b(i) LEFT JOIN h ON h.sample_id = s.sample_id AND h.bin = b.i), {_smooth_sql(4)} SELECT sample_id, bin, round(v, 6) AS smooth FROM s4")
def smooth_121(spark, d):
    """Smoothed display histogram of every sample."""
    h = hist.dense(hist.counted(items(spark, d), ["sample_id"], hist.display_bin(Q.normalised(F.col("q")), 50)), ["sample_id"], 50)

    def run(pdf):
        pdf = pdf.sort_values("bin")
        return pdf.assign(smooth=hist.smooth_121(pdf["n"].to_numpy(), 4))[["sample_id", "bin", "smooth"]]

    return h.groupBy("sample_id").applyInPandas(run, "sample_id string, bin int, smooth double").withColumn("smooth", r6(F.col("smooth")))
