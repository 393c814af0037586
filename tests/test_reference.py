"""Every query with SQL agrees with DuckDB on the smallest tables; operators against small brute-force versions."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cytora import api
from cytora.functions import exprs as X
from cytora.operators import beads, graph, hist, integrate, linalg, ordered, stats, surgery
from cytora.operators.fits import curves, cutoffs, mixtures, special, splines
from cytora.operators.fits.least_squares import least_squares
from cytora.plans import gates as G
from cytora.plans import reference, training
from cytora.plans.gates import Gate, GateError, GateTree, Kind, Operand

INF, NAN = float("inf"), float("nan")


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(df):
    rows = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        rows.append(tuple("null" if v is None or v != v or str(v) == "<NA>" else float(v) if isinstance(v, (float, int, np.number)) else str(v) for v in r))
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(reference.SQL))
def test_sql(name, spark, small, duck):
    got, want = reference.QUERIES[name](spark, small).toPandas(), duck.sql(reference.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(u == v or (isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-6, abs_tol=1e-6)) for u, v in zip(x, y)), (x, y)


@pytest.mark.parametrize("name", sorted(set(reference.QUERIES) - set(reference.SQL)))
def test_without_sql(name, spark, small):
    rows = reference.QUERIES[name](spark, small).toPandas()
    assert len(rows) and not rows.columns.duplicated().any()


@pytest.mark.parametrize("name", sorted(training.QUERIES))
def test_training(name, spark, small):
    df = training.QUERIES[name](spark, small)
    rows = df.collect()
    assert rows and len(rows) == len(set(rows))


# --- gates -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def edge(spark):
    values = [NAN, INF, -INF, 0.0, 10.0, 25.0, 35.0, 50.0, -1e10, None]
    return spark.createDataFrame([("s", a, b) for a in values for b in values], "sample_id string, x double, y double").cache()


def n(df, tree):
    return {(r["population"]): r["n_events"] for r in G.counts(df, tree, "sample_id").collect()}


def test_single_precision_border(edge):
    tree = GateTree().add(Gate("t", Kind.THRESHOLD, "x", "", ((35, 0),), X.Axis(0, 50)))
    got = n(edge, tree)
    assert got["t:More"] == 20  # 50 and +inf; 35 normalises to just below 0.7
    assert got["t:More"] + got["t:Less"] == 100  # NaN and null lie in Less


def test_quadrants_part_finite_events(edge):
    finite = edge.filter(X.fin(F.col("x")) & X.fin(F.col("y")))
    for kind, points in ((Kind.QUADRANT, ((20, 20),)), (Kind.OFFSET, ((20, 20), (10, 0), (30, 0)))):
        got = n(finite, GateTree().add(Gate("q", kind, "x", "y", points, X.Axis(0, 50), X.Axis(0, 50))))
        assert sum(got.values()) == finite.count()


def test_degenerate_gates(edge):
    flat = X.Axis(5, 5)
    tree = GateTree()
    tree.add(Gate("none", Kind.RECTANGLE, "missing", "y", ((0, 0), (1, 1)))).add(Gate("all", Kind.RECTANGLE, "x", "y", ()))
    tree.add(Gate("flat", Kind.RECTANGLE, "x", "y", ((0, 0), (1, 1)), flat, flat)).add(Gate("one", Kind.RECTANGLE, "x", "y", ((0, 0),)))
    tree.add(Gate("line", Kind.POLYGON, "x", "", ((0, 0), (9, 0), (5, 0)))).add(Gate("curl", Kind.CURLY, "x", "y", ()))
    got = n(edge, tree)
    assert (got["none"], got["all"], got["flat"], got["one"], got["line"]) == (0, 100, 100, 0, 0)
    assert all(got[f"curl:{r}"] == 0 for r in G.QUADRANTS)


def test_boolean_gates(edge):
    tree = GateTree().add(Gate("a", Kind.THRESHOLD, "x", "", ((10, 0),), X.Axis(0, 50))).add(Gate("b", Kind.THRESHOLD, "y", "", ((25, 0),), X.Axis(0, 50)))
    for name, kind in (("m", Kind.MERGE), ("e", Kind.EXCLUDE), ("o", Kind.OVERLAP)):
        tree.add(Gate(name, kind, first=Operand("a", "More"), second=Operand("b", "More")))
    tree.add(Gate("u", Kind.MERGE, first=Operand("a", "More"), second=Operand("gone")))
    got = n(edge, tree)
    assert got["e"] + got["o"] == got["a:More"] and got["m"] == got["a:More"] + got["b:More"] - got["o"] and got["u"] == 0
    loop = GateTree([Gate("p", Kind.MERGE, first=Operand("q"), second=Operand("q")), Gate("q", Kind.MERGE, first=Operand("p"), second=Operand("p"))])
    with pytest.raises(GateError):
        G.compile_tree(loop, ["x"])


def test_plan_editing():
    tree = GateTree().add(Gate("a", Kind.THRESHOLD, "x", "", ((1, 0),))).add(Gate("b", Kind.RANGE, "y", "", ((1, 0), (2, 0)), parent="a", parent_region="More"))
    tree.add(Gate("m", Kind.MERGE, first=Operand("b", "InRange"), second=Operand("a", "Less")))
    assert GateTree.from_json(tree.to_json()).gates == tree.gates
    assert [g.name for g in tree.remove("b").gates] == ["a"]
    assert tree.rename_channel("x", "z").get("a").x == "z"
    with pytest.raises(GateError):
        tree.add(Gate("A", Kind.THRESHOLD, "x"))


def test_polygon_against_loop(spark):
    rng = np.random.default_rng(0)
    pts = [(float(a), float(b)) for a, b in rng.uniform(0, 1, (7, 2))]
    xy = rng.uniform(-0.2, 1.2, (800, 2))

    def inside(x, y):
        odd = False
        for (ax, ay), (bx, by) in zip(pts, pts[-1:] + pts[:-1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
        return odd

    df = spark.createDataFrame([(float(a), float(b)) for a, b in xy], "x double, y double")
    got = [r[0] for r in df.select(X.inside_polygon(F.col("x"), F.col("y"), pts)).collect()]
    assert got == [inside(a, b) for a, b in xy]


# --- expressions and statistics --------------------------------------------------------------------------------


@given(st.lists(st.floats(-1e6, 262144), min_size=1, max_size=50))
@settings(max_examples=60, deadline=None)
def test_logicle_round_trip(values):
    s, k = X.Logicle(), X.Logicle().constants()
    v = np.array(values)
    y = s.values(v)
    p = np.where(y < k["x1"], 2 * k["x1"] - y, y)
    back = np.where(y < k["x1"], -1, 1) * (k["a"] * np.exp(k["b"] * p) - k["c"] * np.exp(-k["d"] * p) - k["f"])
    assert np.allclose(back, v, rtol=1e-7, atol=1e-5)
    order = np.argsort(v)
    assert (np.diff(y[order]) >= -1e-12).all()


def test_logicle_known_points():
    s = X.Logicle(262144, 0.5, 4.5, 0)
    assert abs(s.values(np.array([262144.0]))[0] - 1) < 1e-9 and abs(s.values(np.array([0.0]))[0] - 0.5 / 4.5) < 1e-12
    assert np.isnan(s.values(np.array([NAN]))[0])


def test_arcsinh_of_large_negative(spark):
    assert spark.range(1).select(X.arcsinh(F.lit(-1e6))).first()[0] == pytest.approx(math.asinh(-1e6))


def test_statistics_of_edges(spark):
    df = spark.createDataFrame([("a", NAN), ("a", INF), ("a", None), ("b", 4.0), ("b", NAN), ("c", -2.0), ("c", 2.0)], "g string, v double")
    v = stats.kept(F.col("v"))
    got = {r["g"]: r.asDict() for r in df.groupBy("g").agg(*[f(v).alias(k) for k, f in stats.NATIVE.items()]).collect()}
    assert all(got["a"][k] == 0 for k in stats.NATIVE)
    assert (got["b"]["Mean"], got["b"]["Median"], got["b"]["StandardDeviation"], got["b"]["CV"]) == (4, 4, 0, 0)
    assert got["c"]["CV"] == 0 and got["c"]["GeometricMean"] == pytest.approx(2)
    failing = stats.python_statistic(df, "g", ["v"], lambda m, c, p: 1 / 0)
    assert all(math.isnan(r["value"]) for r in failing.collect())


def test_order_operators(spark):
    rng = np.random.default_rng(0)
    rows = [(str(int(g)), int(v), float(i)) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 500), rng.permutation(500)))]
    df = spark.createDataFrame(rows, "g string, k int, v double")
    idx = {(r["g"], r["k"]): r["event_idx"] for r in ordered.row_index(df, ["k"], within="g").collect()}
    sums = {r["k"]: r["s"] for r in ordered.running_sums(df, ["k"], {"v": "s"}).collect()}
    prev = {(r["g"], r["k"]): r["p"] for r in ordered.previous(df, ["k"], "k", "p", "g").collect()}
    for g in "012":
        keys = sorted(k for a, k, _ in rows if a == g)
        assert [idx[g, k] for k in keys] == list(range(len(keys)))
        assert [prev[g, k] for k in keys] == [None, *keys[:-1]]
    total = 0.0
    for _, k, v in sorted(rows, key=lambda r: r[1]):
        total += v
        assert sums[k] == pytest.approx(total)
    assert ordered.row_index(df.limit(0), ["k"]).count() == 0


def test_surgery(spark):
    assert [surgery.half_away(v) for v in (0.5, 1.5, -0.5, 2.4)] == [1, 2, -1, 2]
    assert sorted(["b10", "B2", "a1"], key=surgery.natural_key) == ["a1", "B2", "b10"]
    assert surgery.unique_name("g", {"G", "g 2"}, True) == "g 3"
    df = spark.createDataFrame([(i,) for i in range(97)], "i long")
    for keep in (1, 10, 50, 97, 200):
        got = sorted(r[0] for r in surgery.stride(df, "i", F.lit(97), keep).collect())
        assert got == (list(range(97)) if keep >= 97 else [i * 97 // keep for i in range(keep)])
    m = spark.createDataFrame([("i", "1"), ("i", " "), ("f", "1.5"), ("f", "2"), ("s", "x"), ("s", "1"), ("n", None)], "k string, v string")
    assert {r[0]: r[1] for r in m.groupBy("k").agg(surgery.infer_kind(F.col("v")).alias("t")).collect()} == {"i": "Integer", "f": "Float", "s": "String", "n": "String"}
    part = spark.createDataFrame([(v,) for v in (0.0, 5.0, 9.9, 10.0, -1.0, NAN)], "t double").select(surgery.fragments(F.col("t"), [0, 5, 10])).collect()
    assert [r[0] for r in part] == [0, 1, 1, 1, None, None]


# --- matrices, histograms, fits --------------------------------------------------------------------------------


def test_matrices(spark):
    rng = np.random.default_rng(1)
    m = np.eye(4) + rng.uniform(0, 0.2, (4, 4))
    assert np.allclose(linalg.inverse(m) @ m, np.eye(4), atol=1e-10)
    assert linalg.inverse(np.ones((2, 2))) is None
    df = spark.createDataFrame([(1.0, 2.0), (3.0, NAN)], "a float, b float")
    for same in (None, np.eye(2), np.eye(2) + 5e-7, np.ones((2, 2))):
        assert linalg.compensated(df, ["a", "b"], same).first()["a"] == 1.0
    assert linalg.compensated(df, ["a", "c"], np.array([[1, 0.5], [0.1, 1]])).first()["a"] == 1.0
    spill = np.array([[1, 0.5], [0.1, 1]])
    true = np.array([[10.0, 4.0], [3.0, 8.0]])
    raw = spark.createDataFrame([tuple(map(float, r)) for r in true @ spill], "a float, b float")
    assert np.allclose(linalg.compensated(raw, ["a", "b"], spill).toPandas().to_numpy(), true, atol=1e-4)
    r = linalg.Registry(["a", "b"])
    assert r.add("x", ["a", "b"], np.eye(2) + 1e-7) == 0 and r.add("x", ["a", "b"], spill, True) == 1 and r.chosen == 1
    s = rng.uniform(0, 1, (3, 8))
    assert np.allclose(linalg.unmixing_matrix(s) @ s.T, np.eye(3), atol=1e-9)
    with pytest.raises(ValueError):
        linalg.unmixing_matrix(np.vstack([s, s[0]]))


def test_smoothing():
    v = np.array([0, 0, 4, 0, 0], float)
    assert np.allclose(hist.smooth_121(v, 1), [0, 1, 2, 1, 0])
    g = np.zeros((9, 9))
    g[4, 4] = 1
    assert hist.blur(g, 1).sum() == pytest.approx(1) and np.allclose(hist.blur(np.ones((5, 5)), 3), 1)
    levels = hist.contours(hist.blur(g, 2), 3)
    assert len(levels) == 3 and all(s for _, s in levels)


def test_fits():
    x = np.linspace(0, 100, 400)
    y = curves.gaussian(x, 0.02, 30, 2) + curves.gaussian(x, 0.008, 60, 3) + np.where((x > 30) & (x < 60), 0.001, 0)
    y /= y.sum()
    for model in ("watson", "dean"):
        f = mixtures.cell_cycle(x, y, model)
        assert abs(f["g1_mean"] - 30) < 1 and abs(f["g2_mean"] - 60) < 1.5 and abs(f["g1"] + f["s"] + f["g2"] - 100) < 1e-6
        assert 50 < f["g1"] < 68 and 25 < f["g2"] < 42
    b = np.arange(500) + 0.5
    p = sum(a * np.exp(-((b - 400 + 60 * k) ** 2) / (2 * 12**2)) for k, a in enumerate((0.4, 0.3, 0.2, 0.1)))
    f = mixtures.proliferation(p / p.sum())
    assert np.allclose(f["fractions"][:4], [0.4, 0.3, 0.2, 0.1], atol=0.03) and abs(f["division"] - 1.0) < 0.1
    xs = 5 * np.sinh(np.linspace(0, np.arcsinh(2000 / 5), 101))
    share = 0.6 / (1 + (np.arcsinh(xs / 5) / 3.5) ** 12) + 0.02
    assert 10 < cutoffs.index_cutoff(xs, share) < 400


def test_spline(spark):
    s, g = np.linspace(0, 10, 12), np.sort(np.random.default_rng(0).uniform(0, 20, 12))
    k = splines.knots(s, g)
    assert np.allclose(splines.evaluate(*k, s), g)
    v = np.linspace(-5, 15, 500)
    assert (np.diff(splines.evaluate(*k, v)) >= -1e-9).all()
    assert np.allclose(splines.evaluate(*splines.knots([1, 1], [2, 3]), np.array([7.0])), 7)
    assert np.allclose(splines.evaluate(*splines.knots([1, 1, 2], [2, 4, 5]), np.array([1.0])), 3)
    places, structs = [float(x) for x in splines.padded(k[0], 12)], [tuple(float(x) for x in r) for r in zip(*k)]
    schema = "v double, w float, x array<double>, k array<struct<x:double,y:double,m:double>>"
    df = spark.createDataFrame([(float(x), float(x), places, structs) for x in [*v, *s]] + [(NAN, 1.0, places, structs), (None, 1.0, places, structs), (3.0, 1.0, None, None), (INF, 1.0, places, structs)], schema)
    rows = splines.bent(df, {"v": ("x", "k"), "w": ("x", "k")}, 12).collect()
    n = len(v) + len(s)
    assert np.allclose([r["v"] for r in rows[:n]], splines.evaluate(*k, np.array([*v, *s])))
    assert math.isnan(rows[n]["v"]) and rows[n + 1]["v"] is None and rows[n + 2]["v"] == 3 and rows[n + 3]["v"] == INF


def test_integration(spark):
    rng = np.random.default_rng(5)
    rows = [(b, float(v * f + o), i) for b, f, o, n in (("a", 1, 0, 400), ("b", 1.5, 3, 300), ("few", 9, 9, 49)) for i, v in enumerate(rng.normal(10, 2, n))] + [(None, 5.0, 0), ("a", NAN, 0)]
    df = spark.createDataFrame(rows, "batch string, v double, x int")
    got = integrate.integrated(df, "batch", ["v"]).toPandas()
    assert list(got.columns) == ["batch", "v", "x"] and len(got) == len(rows)
    m = got.dropna().groupby("batch").v.median()
    assert abs(m["a"] - m["b"]) < 0.2 and abs(m["few"] - np.median([r[1] for r in rows if r[0] == "few"])) < 1e-4
    assert got[got.batch.isna()].v.tolist() == [5.0]
    to_a = integrate.integrated(df, "batch", ["v"], goal="batch", label="a").toPandas().dropna().groupby("batch").v.median()
    assert abs(to_a["b"] - np.median([r[1] for r in rows if r[0] == "a" and r[1] == r[1]])) < 0.2
    alone = integrate.integrated(df.filter("batch = 'b'"), "batch", ["v"]).toPandas()
    assert np.allclose(alone.v, [r[1] for r in rows if r[0] == "b"], atol=1e-5)


def test_planted_phases_and_cutoffs():
    rng = np.random.default_rng(3)
    x = np.linspace(0, 100, 400)
    for shares in ((0.6, 0.2, 0.2), (0.35, 0.45, 0.2), (0.8, 0.05, 0.15)):
        n = rng.multinomial(40_000, shares)
        values = np.concatenate([rng.normal(30, 1.5, n[0]), rng.uniform(30, 60, n[1]), rng.normal(60, 2.5, n[2])])
        y = np.histogram(values, bins=400, range=(0, 100))[0] / len(values)
        for model, slack in (("dean", 4), ("watson", 17 if shares[1] > 0.4 else 8)):  # what the peaks leave is too little where much lies beneath them
            f = mixtures.cell_cycle(x, curves.smooth(y, 2), model)
            assert np.allclose([f["g1"], f["s"], f["g2"]], 100 * np.array(shares), atol=slack)
    for generations in ((0.5, 0.3, 0.2), (0.1, 0.2, 0.4, 0.2, 0.1)):
        n = rng.multinomial(30_000, generations)
        values = np.concatenate([rng.normal(420 - 70 * k, 14, m) for k, m in enumerate(n)])
        f = mixtures.proliferation(np.histogram(values, bins=500, range=(0, 500))[0] / len(values))
        assert np.allclose(f["fractions"][: len(generations)], generations, atol=0.02) and abs(f["step"] - 70) < 3
    t = np.linspace(0, np.arcsinh(400), 101)
    height, steepness, middle, error = cutoffs.log_logistic(t[1:], 0.7 / (1 + (t[1:] / 3.0) ** 9))
    assert np.allclose([height, steepness, middle], [0.7, 9, 3], rtol=1e-3) and error < 1e-9
    line = np.maximum(0.8 - 0.1 * t, 0)
    assert abs(cutoffs.line_cutoff(t, line)[0] - 4) < 0.2
    assert mixtures.cell_cycle(x, np.zeros(400))["g1"] == 0
    assert cutoffs.index_cutoff(np.zeros(5), np.ones(5)) is None


def test_exact_quantiles(spark):
    rng = np.random.default_rng(4)
    rows = [("a", float(v), float(-v)) for v in np.round(rng.lognormal(0, 3, 700), 2)] + [("b", v, v) for v in (0.0, -0.0, 1.0, NAN, INF, None)] + [(None, 5.0, None), ("c", None, NAN)]
    rows += [("d", 7.25, -1e300)] * 50
    df = spark.createDataFrame(rows, "g string, x double, y double")
    probs = [0.0, 0.013, 0.5, 0.75, 0.999, 1.0]
    got = {(r["g"], r["channel"]): (r["n"], r["q"]) for r in stats.exact_quantiles(df, ["g"], ["x", "y"], probs).collect()}
    for c, k in (("x", 1), ("y", 2)):
        for g in ("a", "b", None, "c", "d"):
            own = [r[k] for r in rows if r[0] == g and r[k] is not None and math.isfinite(r[k])]
            if own:
                assert got[g, c][0] == len(own) and np.allclose(got[g, c][1], np.quantile(own, probs), rtol=1e-12)
            else:
                assert (g, c) not in got
    weighted = spark.createDataFrame([(1.0, 3), (2.0, 1), (9.0, 4)], "x double, n int")
    assert np.allclose(stats.exact_quantiles(weighted, [], ["x"], [0.25, 0.5, 0.6], "n").first()["q"], np.quantile([1, 1, 1, 2, 9, 9, 9, 9], [0.25, 0.5, 0.6]))
    assert stats.exact_quantiles(df.limit(0), ["g"], ["x"], [0.5]).count() == 0


def test_reservoir(spark):
    df = spark.range(5000).withColumnRenamed("id", "key").withColumn("size", F.lit("clash"))
    for size in (0, 1, 700, 4999, 5000, 9000):
        got = [r["key"] for r in surgery.reservoir(df, "key", size, 3).collect()]
        assert len(got) == len(set(got)) == min(size, 5000)
    kept = np.array([r["key"] for r in surgery.reservoir(df, "key", 1000, 5).collect()])
    assert abs(kept.mean() - 2500) < 200 and set(r["key"] for r in surgery.reservoir(df, "key", 500, 5).collect()) < set(kept.tolist())


def test_special():
    assert special.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and special.chi2_sf(20, 10) == pytest.approx(0.0292527, abs=1e-6)
    assert special.normal_sf(1.959964) == pytest.approx(0.025, abs=1e-7)
    assert special.ks_sf(0.1, 1000, 1000) == pytest.approx(9.1e-5, rel=0.02)
    assert special.normality_p(1000, 0.0, 3 * 999 / 1001) == pytest.approx(1, abs=0.02)
    p, cost = least_squares(lambda p: np.array([p[0] - 3, 10 * (p[1] + 1)]), np.zeros(2), np.array([-5, 0.0]), np.array([5, 5.0]))
    assert p[0] == pytest.approx(3) and p[1] == 0 and cost == pytest.approx(100)


def test_curve_cycle(spark):
    c = {"a": curves.Curve("addition", {}, (), (("b", 1.0),)), "b": curves.Curve("addition", {}, (), (("a", 1.0),))}
    assert math.isnan(spark.range(1).select(curves.curve_column("a", c, F.lit(1.0))).first()[0])


def test_asof(spark):
    knots = spark.createDataFrame([("g", 0.0, 1.0), ("g", 10.0, 2.0), ("g", 11.0, 5.0), ("h", 3.0, 7.0)], "g string, kx double, ky double")
    df = spark.createDataFrame([("g", -5.0), ("g", 0.0), ("g", 5.0), ("g", 10.0), ("g", 10.5), ("g", 99.0), ("h", 1.0), ("none", 1.0)], "g string, x double")
    got = {(r["g"], r["x"]): r["v"] for r in beads.asof_interpolate(df, knots, ["g"], "x", "kx", "ky", "v").collect()}
    assert got == {("g", -5.0): 1, ("g", 0.0): 1, ("g", 5.0): 1.5, ("g", 10.0): 2, ("g", 10.5): 3.5, ("g", 99.0): 5, ("h", 1.0): 7, ("none", 1.0): None}


def test_neighbours_beyond_the_exact_size(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(600, 6)))], "vec_id long, x array<double>")
    for metric in ("cosine", "euclidean"):
        exact = {(r["vec_id"], r["other"]) for r in graph.knn_graph(df, 6, metric).collect()}
        near = {(r["vec_id"], r["other"]) for r in graph.knn_graph(df, 6, metric, exact_rows=100).collect()}
        assert len(exact) == 3600 and near == exact


def test_neighbours_do_not_depend_on_the_exact_size(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", F.col("embedding").alias("x")).filter("vec_id % 3 = 0")
    whole = {(r["vec_id"], r["rank"]): (r["other"], r["distance"]) for r in graph.knn_graph(rows, 15).collect()}
    split = {(r["vec_id"], r["rank"]): (r["other"], r["distance"]) for r in graph.knn_graph(rows, 15, exact_rows=200).collect()}
    assert len(whole) > 9000 and whole.keys() == split.keys()
    assert all(abs(split[at][1] - d) < 1e-9 for at, (_, d) in whole.items())
    assert sum(split[at][0] == o for at, (o, _) in whole.items()) > 0.999 * len(whole)


def test_facade(spark):
    df = spark.createDataFrame([("s", 10.0, 1.0), ("s", 200.0, 2.0), ("t", 300.0, 4.0)], "sample_id string, a float, b float")
    g = api.Workspace().add(api.Grouping("g", df, ["a", "b"]))
    g.strategy.define_gate_threshold("hi", "a", 100).define_gate_range("mid", "b", 1.5, 3, parent="hi", region="More").define_statistics("Mean", "b")
    g.strategy.define_gate_exclude("out", "hi:More", "mid:InRange")
    rows = {(r["sample_id"], r["population"], r["kind"]): r["value"] for r in g.evaluate().collect()}
    assert rows["s", "hi:More", "NumberOfEvents"] == 1 and rows["s", "mid:InRange", "FrequencyOfParent"] == 100 and rows["t", "out", "Mean"] == 4
    assert g.population("hi:More").count() == 2 and g.statistic_table().count() == 2
    with pytest.raises(GateError):
        g.strategy.define_gate_polygon("p", "a", "b", [(0, 0)])
