"""Operators against small brute-force versions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytora import api, session
from cytora.functions import exprs as X
from cytora.functions.exprs import Axis
from cytora.operators import beads, channels, compare, graph, linalg, normalise, ordered, platforms, spectra
from cytora.operators.fits import special
from cytora.plans.gates import Gate, GateError, GateTree, Kind, Operand
from cytora.sources import demo, fcs

NAN, INF = float("nan"), float("inf")


def test_scan_and_index(spark):
    rng = np.random.default_rng(0)
    rows = [(str(rng.choice(["a", "b"])) if i % 50 else None, float(v), int(n)) for i, (v, n) in enumerate(zip(rng.permutation(600), rng.integers(0, 9, 600)))]
    df = spark.createDataFrame(rows, "g string, v double, n int").repartition(5)
    p = pd.DataFrame(rows, columns=["g", "v", "n"]).sort_values("v")
    got = ordered.scan(df, ["v"], {"n": "upto"}, {"v": "before"}, "g").toPandas().sort_values("v")
    groups = p.groupby(p.g.fillna("~"))
    assert np.array_equal(got.upto, groups.n.cumsum().loc[p.index]) and np.array_equal(got.before, groups.v.shift().loc[p.index], equal_nan=True)
    whole = ordered.scan(df, ["v"], {"n": "upto"}, {"v": "before"}).toPandas().sort_values("v")
    assert np.array_equal(whole.upto, p.n.cumsum()) and np.array_equal(whole.before, p.v.shift(), equal_nan=True)
    idx = ordered.row_index(df, ["v"], "i", "g", "total").toPandas().sort_values("v")
    assert np.array_equal(idx.i, groups.cumcount().loc[p.index]) and (idx.total == groups.n.transform("size").loc[p.index].to_numpy()).all()
    assert ordered.scan(df.limit(0), ["v"], {"n": "upto"}, {"v": "before"}, "g").count() == 0


def test_asof_in_pieces(spark):
    rng = np.random.default_rng(1)
    xs = np.sort(np.concatenate([rng.uniform(0, 1, 150), rng.uniform(900, 1000, 50)]))  # bunched, then a pause
    ys = rng.normal(size=200)
    knots = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(xs, ys)], "g string, kx double, ky double")
    at = np.concatenate([rng.uniform(-1, 1001, 300), xs[:20]])
    df = spark.createDataFrame([("g", float(v), "clash") for v in at] + [("h", 1.0, "x"), ("g", None, "x")], "g string, x double, ky string")
    rows = beads.asof_interpolate(df, knots, ["g"], "x", "kx", "ky", "v").collect()
    got = {r["x"]: r["v"] for r in rows if r["g"] == "g" and r["x"] is not None}
    assert len(rows) == len(at) + 2 and all(abs(got[v] - np.interp(v, xs, ys)) < 1e-9 for v in at)
    assert [r["v"] for r in rows if r["g"] == "h" or r["x"] is None] == [None, None]


def test_channels(spark):
    names = ["Time", "FSC-A", "BCKG190Di", "Width", "Event_length", "Nd142Di", "142Nd", "B525-A", None, ""]
    df = spark.createDataFrame([(n, k) for n in names for k in (None, " Spectrum ", "")], "n string, k string")
    for r in df.select("n", "k", channels.kind_column(F.col("k"), F.col("n")).alias("kind")).collect():
        assert r["kind"] == channels.channel_kind(r["k"], r["n"])
    assert channels.is_compensable("B525-A") and not channels.is_compensable("SSC-H")
    e = spark.createDataFrame([("s", 0, 1.0, 2.0), ("s", 1, 3.0, 4.0)], "sample string, i int, a double, b double")
    assert channels.projected(e, ["b", "a"], ["sample"]).columns == ["sample", "b", "a"]
    with pytest.raises(channels.ChannelError, match="zz"):
        channels.import_control(e, ["a", "zz"], ["sample"])
    emb = spark.createDataFrame([("s", 0, "a", 9.0)], "sample string, i int, name string, value double")
    shadow = {r["i"]: r["value"] for r in channels.channel_values(e, "a", ["sample", "i"], emb).collect()}
    assert shadow[0] == 9 and math.isnan(shadow[1])
    assert [r["value"] for r in channels.channel_values(e, "b", ["sample", "i"], emb).orderBy("i").collect()] == [2, 4]
    assert channels.channel_values(e, "zz", ["sample", "i"]).count() == 0
    wanted = spark.createDataFrame([("s", 1), ("s", 7)], "sample string, i int")
    assert [r["value"] for r in channels.control_values(e, "a", wanted, ["sample", "i"]).orderBy("i").collect()][0] == 3
    c = spark.createDataFrame([("s", "b"), ("s", "a"), ("t", "a"), ("t", "b"), ("t", "c"), (None, "a"), ("s", None)], "sample string, name string")
    assert [r[0] for r in channels.shared_channels(c, "sample", "name").collect()] == ["a", "b"]


def test_comparison(spark):
    rng = np.random.default_rng(2)
    data = {"A": np.round(rng.normal(5, 2, 400)), "B": np.round(rng.normal(6, 2, 300)), "C": rng.normal(5, 2, 50), "few": np.array([1.0])}
    rows = [(g, float(v), 0) for g, vs in data.items() for v in vs] + [("B", NAN, 0), ("B", None, 0), (None, 3.0, 0)]
    df = spark.createDataFrame(rows, "g string, v double, n1 int")
    got = {r["g"]: r for r in compare.rank_statistics(df, "g", "v", "A").collect()}
    assert set(got) == {"B", "C", "few"}
    a = data["A"]
    for g, r in got.items():
        b = data[g]
        u = (b[:, None] > a[None]).sum() + 0.5 * (b[:, None] == a[None]).sum()
        grid = np.unique(np.concatenate([a, b]))
        ks = max(abs((b <= v).mean() - (a <= v).mean()) for v in grid)
        _, t = np.unique(np.concatenate([a, b]), return_counts=True)
        assert r["u"] == u and abs(r["ks"] - ks) < 1e-12 and r["ties"] == (t.astype(float) ** 3 - t).sum() and (r["n1"], r["n2"]) == (len(b), len(a))
    chi = {r["g"]: r for r in compare.chi_square(df, "g", "v", "A", 0.0, 10.0, 20).collect()}
    for g in ("B", "C"):
        o, e = (np.histogram(x, bins=20, range=(0, 10))[0].astype(float) for x in (data[g], a))
        keep = o + e > 0
        o, e = o[keep], e[keep] + 1e-9
        e *= o.sum() / e.sum()
        assert chi[g]["chi2"] == pytest.approx(((o - e) ** 2 / e).sum(), rel=1e-6) and chi[g]["dof"] == keep.sum() - 1
    tests = {r["g"]: r for r in compare.intensity_tests(df, "g", "v", "A", 0.0, 10.0, 20).collect()}
    assert set(tests) == set(data) and tests["B"]["mann_whitney_p"] == pytest.approx(special.mann_whitney_p(got["B"]["u"], 300, 400, got["B"]["ties"]))
    assert tests["B"]["z_p"] < 1e-4 and 0 <= tests["B"]["chi_square_p"] < 0.01 and tests["C"]["ks_p"] > 1e-3
    assert tests["A"]["z_p"] is None or math.isnan(tests["A"]["z_p"])
    assert compare.rank_statistics(df.limit(0), "g", "v", "A").count() == 0


def test_platform_inputs(spark):
    e = spark.createDataFrame([("s", 0, 1.0, NAN, "x"), ("s", 1, 5.0, 2.0, "x"), ("t", 0, 9.0, -3.0, "y"), ("t", 1, 2.0, INF, None)], "sample string, i int, a double, b double, batch string")
    masks = {"low": X.below(F.col("a"), 6.0), "high": X.at_least(F.col("a"), 4.0)}
    S = platforms.Source
    rows = platforms.platform_input(e, masks, [S("low"), S("high", "t")], ["b"], "sample", "i", "batch")
    assert sorted((r["source_id"], r["sample"], r["i"]) for r in rows.collect()) == [(0, "s", 0), (0, "s", 1), (1, "t", 0)]
    with pytest.raises(platforms.OverlapError):
        platforms.platform_input(e, masks, [S("low"), S("high")], ["b"], "sample", "i", "batch", integration=True)
    with pytest.raises(ValueError, match="t has no batch"):
        platforms.platform_input(e, masks, [S("low")], ["b"], "sample", "i", "batch", integration=True)
    with pytest.raises(KeyError):
        platforms.source_rows(e, masks, [S("none")], ["b"], "sample", "i")
    with pytest.raises(channels.ChannelError):
        platforms.source_rows(e, masks, [S("low")], ["zz"], "sample", "i")
    m = platforms.row_map(platforms.source_rows(e, {"g:More": masks["high"]}, [S("g:More")], [], "sample", "i"), "sample", "i", "grp", "id").collect()
    assert {(r["gate_id"], r["region"], r["group"]) for r in m} == {("g", "More", "grp")} and len(m) == 2
    assert platforms.has_batches(e, "batch") and not platforms.has_batches(e.filter("batch = 'x'"), "batch")
    log = [r["b"] for r in platforms.transformed(e, ["b"], Axis(0, 1, "log")).orderBy("sample", "i").collect()]
    assert math.isnan(log[0]) and math.isnan(log[3]) and abs(log[1] - math.log10(3)) < 1e-6
    own = platforms.integration_transformed(e, {"a": Axis(0, 1, "arcsinh", 5.0), "b": Axis(0, 1, "linear")}).orderBy("sample", "i").collect()
    assert abs(own[1]["a"] - math.asinh(1)) < 1e-6 and math.isnan(own[3]["b"])
    z = [r["a"] for r in platforms.scaled(e, ["a"]).orderBy("sample", "i").collect()]
    v = np.array([1, 5, 9, 2.0])
    assert np.allclose(z, (v - v.mean()) / v.std(ddof=1), atol=1e-6)
    one = platforms.concatenated(e, masks, {"t": ["high"], "s": ["low", "high"]}, "sample", "both").collect()
    assert {r["sample"] for r in one} == {"both"} and sorted((r["source_sample"], r["i"]) for r in one) == [("s", 0), ("s", 1), ("t", 0)]
    kept, meta = platforms.demultiplexed(e, F.when(F.col("a") >= 4, 1).otherwise(0), ["a"], "sample", spark.createDataFrame([("s", 2)], "sample string, threshold int"))
    assert {(r["source_sample"], r["signature"], r["events"]) for r in meta.collect()} == {("t", "a=+", 1), ("t", "a=-", 1)} and kept.count() == 2
    again = platforms.demultiplexed(e, F.when(F.col("a") >= 4, 1).otherwise(0), ["a"], "sample")[1]
    assert {r["derived_id"] for r in meta.collect()} <= {r["derived_id"] for r in again.collect()}
    with pytest.raises(platforms.OwnedError):
        platforms.commit(e, "other", "me", kept, {})
    assert "provenance_step" in platforms.commit(e.limit(0), None, "me", kept, {"step": "demultiplex"}).columns
    assert platforms.even_places(10, 4) == [0, 3, 6, 9] and platforms.even_places(3, 9) == [0, 1, 2]


def test_beads_of_several_isotopes(spark):
    rng = np.random.default_rng(6)
    n, drift = 3000, lambda t: 1 - 0.4 * t
    t = np.sort(rng.uniform(0, 1, n))
    bead = rng.random(n) < 0.3
    signal = np.where(bead[:, None], rng.normal([3000, 2000], 60, (n, 2)), rng.exponential(80, (n, 2))) * drift(t)[:, None]
    dna = np.where(bead, rng.exponential(1, n), rng.normal(500, 50, n))
    other = rng.normal(100, 2, n) * drift(t)
    df = spark.createDataFrame([("s", i, float(t[i]), *map(float, signal[i]), float(other[i]), float(dna[i])) for i in range(n)] + [("few", 0, 0.5, 1.0, 1.0, 1.0, 1.0)], "sample string, i int, time double, m140 double, m175 double, m150 double, dna double")
    iso = [normalise.Isotope(140, "m140", 3000.0), normalise.Isotope(175, "m175", 2000.0)]
    marked = normalise.annotated(df, "sample", iso, "dna").filter("sample = 's'").toPandas().sort_values("i")
    assert (marked.is_bead.to_numpy() == bead).mean() > 0.85 and not (marked.is_bead & ~bead).any()
    done = normalise.normalised(df, "sample", "time", iso, {"m140": 140, "m175": 175, "m150": 150}, ["i"], "dna").filter("sample = 's'").toPandas().sort_values("i")
    assert len(done) == n
    for c, want in (("m150", 100.0),):
        early, late = done[c][t < 0.2].median(), done[c][t > 0.8].median()
        assert abs(early / late - 1) < 0.03 and abs(early / want - 1) < 0.05
    kept = normalise.normalised(df, "sample", "time", iso, {"m150": 150}, ["i"], "dna", remove=True)
    assert kept.filter("sample = 's'").count() == n - marked.is_removed.sum() and kept.filter("sample = 'few'").count() == 0
    f = spark.range(1).select(*[normalise.across_mass([(140, F.lit(2.0)), (175, F.lit(9.0))], m).alias(str(m)) for m in (140, 150, 175, 105, 210)]).first()
    assert np.allclose(list(f), [2, 4, 9, -5, 16])
    for bad in (iso[:1], [iso[0], normalise.Isotope(175, "zz")], [iso[0], normalise.Isotope(175, "m175", 0.0)]):
        with pytest.raises(normalise.BeadError):
            normalise.normalised(df, "sample", "time", bad, {}, ["i"])


def test_spectra(spark):
    rng = np.random.default_rng(7)
    shapes = np.array([[0.05, 0.2, 1.0, 0.4], [1.0, 0.5, 0.1, 0.0]])
    af = np.array([0.3, 0.3, 0.2, 0.5])
    rows = []
    for k in range(3):
        for i in range(400):
            s = rng.uniform(1, 5, 2)
            x = af * s.sum() * 10 + (shapes[k - 1] * rng.uniform(2000, 9000) if k and i % 2 else 0) + rng.normal(0, 2, 4)
            rows.append((["blank", "one", "two"][k], i, [float(v) for v in s], [float(v) for v in x]))
    rows += [("blank", 900, [NAN, 1.0], [1.0] * 4), ("one", 901, [1.0, NAN], [1e5] * 4)]
    df = spark.createDataFrame(rows, "control string, event int, scatter array<float>, detectors array<float>")
    names, s, similar, m = spectra.fit(df, "control", "event", "scatter", "detectors", ["blank"], {"one": "CD3 ", "two": "CD4"})
    assert names == ["CD3", "CD4", "AF"] and np.allclose(s[:2], shapes, atol=0.02) and np.allclose(s[2], af / 0.5, atol=0.05)
    assert np.allclose(m @ s.T, np.eye(3), atol=1e-6) and np.allclose(np.diag(similar), 1, atol=1e-6)
    for blanks, molecules in (([], {"one": "a"}), (["blank"], {}), (["blank"], {"one": "a", "two": "A "}), (["blank"], {"one": "a", "none": "b"})):
        with pytest.raises(spectra.SpectralError):
            spectra.fit(df, "control", "event", "scatter", "detectors", blanks, molecules)
    near = spectra.nearest_blanks(df.filter("control = 'one'"), df.filter("control = 'blank'"), "event", "scatter", ["event"], most=90)
    b = np.array([r[2] for r in rows[:400]], dtype=np.float32).astype(float)
    got = {(r["event"], r["rank"]): r["blank"] for r in near.collect()}
    assert len(got) == 800
    for i in range(0, 400, 37):
        d = ((np.array(rows[400 + i][2], dtype=np.float32).astype(float) - b) ** 2).sum(axis=1)
        assert [got[i, 1], got[i, 2]] == np.argsort(d, kind="stable")[:2].tolist()
    inside = df.filter(spectra.raw_gate(F.col("scatter")[0], F.col("scatter")[1], [(1, 1), (3, 1), (3, 3), (1, 3)]))
    assert 0 < inside.count() < df.count() and df.filter(spectra.raw_gate(F.col("scatter")[0], F.col("scatter")[1], [])).count() == df.count()


def test_copy_and_paste():
    t = GateTree().add(Gate("a", Kind.THRESHOLD, "X", vertices=((1, 0),))).add(Gate("b", Kind.RANGE, "Y", vertices=((1, 0), (2, 0)), parent="a", parent_region="More"))
    t.add(Gate("c", Kind.MERGE, first=Operand("a", "More"), second=Operand("b", "InRange")))
    assert [g.name for g in t.copied("c")] == ["a", "b", "c"] and [g.name for g in t.copied("a")] == ["a", "b"]
    p = t.paste(t.copied("c"), ["x", "y"])
    assert [g.name for g in p.gates[3:]] == ["a 2", "b 2", "c 2"] and p.get("b 2").parent == "a 2" and p.get("c 2").second == Operand("b 2", "InRange") and p.get("a 2").x == "x"
    assert [g.name for g in t.paste(t.copied("c"), ["x"]).gates[3:]] == ["a 2"]
    assert [g.name for g in t.remove_channel("Y").gates] == ["a"]
    with pytest.raises(GateError):
        loop = GateTree([Gate("u", Kind.MERGE, first=Operand("v"), second=Operand("v")), Gate("v", Kind.MERGE, first=Operand("u"), second=Operand("u"))])
        loop.copied("u")


def test_scripting(spark, tmp_path):
    df = spark.createDataFrame([("s", 0, 10.0, 1.0), ("s", 1, 200.0, 2.0), ("s", 2, 300.0, 6.0), ("t", 0, 300.0, 4.0)], "sample_id string, event_idx long, a float, b float")
    w = api.Workspace()
    g = w.add(api.Grouping("g", df, ["a", "b"]))
    g.strategy.define_gate_threshold("hi", "a", 100).define_statistics("Median", "b").define_statistics("Mean", "b")
    g.strategy.define_statistics_python("span", lambda m, names, p: (m[:, names.index("b")].max() - m[:, names.index("b")].min()) * p["scale"], ["b"], {"scale": "2"}, (api.Requirement("scale", "integer", 1),))
    assert g.strategy.children() == ["hi"] and g.strategy["hi"].x == "a" and g.strategy.resolve("More") == "hi:More" and g.strategy.resolve("hi Less") == "hi:Less"
    with pytest.raises(KeyError):
        g.strategy.resolve("nothing")
    value = lambda key, kind, channel=None: {r["sample_id"]: r["value"] for r in g.get_statistics(key, kind, channel).collect()}
    assert value("More", "span") == {"s": 8.0, "t": 0.0} and value("More", "Median", "b") == {"s": 4.0, "t": 4.0}
    assert value("Less", "Median", "b") == {"s": 1.0, "t": 0.0} and value("More", "Mean", "b") == {"s": 4.0, "t": 4.0}
    assert math.isnan(value("More", "CV", "b")["s"]) and math.isnan(value("Less", "span")["t"])
    assert g.statistic_table().count() == 2
    p = g.get_population("hi:More", "s")
    assert [r["mask"] for r in p.mask().orderBy("event_idx").collect()] == [False, True, True]
    g.set_compensation(g.create_compensation("m", np.array([[1, 0.0], [0.0, 2.0]])))
    assert [r["b"] for r in p.matrix().orderBy("event_idx").collect()] == [2, 6] and [r["b"] for r in p.compensated_matrix(["b"]).orderBy("event_idx").collect()] == [1, 3]
    p.set_embedding("u", spark.createDataFrame([(1, 5.0)], "event_idx long, value double"))
    g.strategy.define_gate_threshold("by u", "u", 1)
    assert g.population("by u:More").select("event_idx").collect()[0][0] == 1
    assert g.row_map(["hi:More"]).count() == 3
    tables = w.run(lambda rows, par: {"n": rows.groupBy("population").count(), "embedding:twice": rows.select("sample_id", "event_idx", (F.col("a") * par["k"]).alias("value"))}, "g", ["hi:More"], ["a"], {"k": 2})
    assert tables["n"].first()["count"] == 3 and g.compensated().filter("twice = 600").count() == 2
    built = []
    for _ in range(2):
        assert w.cached("x", lambda: built.append(1) or df).count() == 4
    assert built == [1]
    with pytest.raises(ValueError):
        g.strategy.define_statistics_python("bad", lambda m, n, p: 0, ["b"], {"mode": "z"}, (api.Requirement("mode", "enum", "x", ("x", "y")),))
    fcs.register(spark)
    for n in ("one", "two"):
        fcs.write(str(tmp_path / f"{n}.fcs"), np.arange(6).reshape(3, 2), ["a", "b"])
    f = api.Grouping("files", None, []).add_fcs(spark, str(tmp_path))
    assert f.channels == ["a", "b"] and f.events.count() == 6
    with pytest.raises(channels.ChannelError):
        api.Grouping("files", None, ["zz"]).add_fcs(spark, str(tmp_path))


def test_demo(spark):
    g = demo.group(spark, (500, 300, 200))
    rows = g.evaluate().filter("kind = 'NumberOfEvents'").collect()
    assert len(rows) == 3 and all(0 < r["value"] < 500 for r in rows)
    assert demo.events(spark).groupBy("sample_id").count().agg(F.sum("count")).first()[0] == sum(demo.SIZES)


def test_tables_are_removed(spark):
    import os

    since = session.tables_written()
    t = session.materialise(spark.range(5).toDF("i"))
    path = t.inputFiles()[0].replace("file://", "").rpartition("/")[0]
    assert os.path.isdir(path) and t.count() == 5
    session.drop_tables(since)
    assert not os.path.exists(path) and session.tables_written() == since


def test_unmixed_is_the_operator(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<float>")
    out = df.select(*[c.alias(n) for n, c in linalg.unmixed("x", {"m": [1.0, 0.5, 2.0]}).items()]).first()
    assert out["m"] == 8.0


def test_fuzzy_union(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 3))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, x array<double>")
    g = graph.knn_graph(df, 8, "euclidean")
    w = {(r["a"], r["b"]): r["weight"] for r in graph.fuzzy_union(g, 8).collect()}
    edges = {}
    for r in g.filter("rank > 0").collect():
        edges.setdefault(r["vec_id"], []).append((r["distance"], r["other"]))
    assert all(a < b and 0 < v <= 1 + 1e-12 for (a, b), v in w.items())
    for i, e in edges.items():  # the nearest neighbour belongs entirely
        j = min(e)[1]
        assert w[min(i, j), max(i, j)] == pytest.approx(1)
    assert set(w) == {(min(i, j), max(i, j)) for i, e in edges.items() for _, j in e}


def test_scales_alike():
    assert Axis(0, 1, "arcsinh", 5.0).same_scale(Axis(2, 9, "arcsinh", 5.0 + 1e-13)) and not Axis(0, 1, "arcsinh", 5.0).same_scale(Axis(0, 1, "arcsinh", 6.0))
    assert Axis(0, 1).same_scale(Axis(0, 5)) and not Axis(0, 1).same_scale(Axis(0, 1, "log")) and not Axis(0, 1, "logicle").same_scale(Axis(0, 1, "logicle", 5.0, X.Logicle(t=1000.0)))
