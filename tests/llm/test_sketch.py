import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cytora.llm import sketch


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.lognormal(3, 2, 4000), -rng.lognormal(1, 1, 1500), np.zeros(300), [1e-35, 1e30, -1e30]])
    rng.shuffle(values)
    rows = [("a" if i % 3 else "b", i % 5, float(v), "clash") for i, v in enumerate(values)]
    rows += [("a", 0, None, "x"), ("a", 0, float("nan"), "x"), ("b", 1, float("inf"), "x"), ("empty", 1, None, "x"), (None, 1, 5.0, "x")]
    return spark.createDataFrame(rows, "g string, day int, v double, n string"), rows


def test_error_bound_and_merge(frame):
    df, rows = frame
    days = sketch.sketch(df, ["g", "day"], "v")
    got = {(r["g"], r["p"]): r for r in sketch.percentiles(sketch.merge(days, ["g"]), ["g"]).collect()}
    direct = {(r["g"], r["p"]): r for r in sketch.percentiles(sketch.sketch(df, ["g"], "v"), ["g"]).collect()}
    assert got == direct
    for g in ("a", "b", None):
        v = np.sort([r[2] for r in rows if r[0] == g and r[2] is not None and np.isfinite(r[2])])
        for p in sketch.PERCENTILES:
            exact, est = v[int(np.floor(p * (len(v) - 1)))], got[g, p]["estimate"]
            assert got[g, p]["n_values"] == len(v)
            assert abs(est - exact) <= sketch.ACCURACY * abs(exact) + 1e-29
    assert ("empty", 0.5) not in got


@given(st.floats(min_value=-1e30, max_value=1e30, allow_nan=False))
@settings(max_examples=25, deadline=None)
def test_bucket_holds_its_value(spark, v):
    r = spark.range(1).select(sketch.bucket_value(sketch.bucket(F.lit(v))).alias("e")).first()
    assert abs(r["e"] - v) <= sketch.ACCURACY * abs(v) * (1 + 1e-9) + 1e-29


def test_order_of_buckets(spark):
    xs = sorted([-1e5, -3.0, -0.5, 0.0, 0.2, 1.0, 7.0, 1e9])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", sketch.bucket(F.col("x")).alias("b"))
    b = [r["b"] for r in df.orderBy("i").collect()]
    assert b == sorted(b)


def test_tables(spark):
    ev = spark.createDataFrame([(1, "g", [1.0, None, float("nan")], None), (1, "g", [1.0, None, float("nan")], None), (2, "g", None, None), (None, "g", [9.0], None)], "event_id long, group_id string, event_values array<float>, loaded_at timestamp")
    rows = sketch.event_sketches(ev).collect()
    assert [(r["group_id"], r["channel_idx"], r["n"]) for r in rows] == [("g", 0, 1)]
    assert sketch.event_sketches(ev.limit(0)).count() == 0
    ms = spark.createDataFrame([(1, 1, "c", 5, 2.0, None), (1, 1, "c", 5, 2.0, None), (1, 2, None, 5, 2.0, None)], "series_id long, bin_idx int, cytometer string, mass_number int, raw_median double, loaded_at timestamp")
    assert sorted((r["cytometer"] or "", r["n"]) for r in sketch.series_sketches(ms).collect()) == [("", 1), ("c", 1)]
