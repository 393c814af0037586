import numpy as np
import pytest

from cytora.operators import spikes


def series(n=120, seed=1, level=1000.0, sd=20.0):
    rng = np.random.default_rng(seed)
    return level + rng.normal(0, sd, n), np.cumsum(rng.uniform(800, 1200, n))


def judge(raw, time, maximum=8192.0, has_raw=None):
    return spikes.judge(np.asarray(raw, float), np.asarray(time, float), np.ones(len(raw), bool) if has_raw is None else has_raw, np.ones(len(raw), bool), maximum, 3)


def test_spikes_and_what_is_none():
    raw, t = series()
    raw[30] += 500
    raw[60:63] -= 400
    raw[90:] += 600  # a lasting change
    f = judge(raw, t)
    assert sorted(np.flatnonzero(f["spike"])) == [30, 60, 61, 62]
    drift, t = series()
    assert not judge(drift + np.linspace(0, 900, 120), t)["spike"].any()


def test_limits_runs_clock():
    raw, t = series()
    raw[3], raw[4], raw[5], raw[6] = np.nan, np.inf, -1, 9000
    raw[20:28] = raw[20]
    raw[40:47] = raw[40]
    t[50], t[51], t[70] = -3, t[50 - 1], t[70] * 5
    t[80] = t[79]
    t[90:] += 1e6  # a pause
    f = judge(raw, t)
    assert list(np.flatnonzero(f["limit"])) == [3, 4, 5, 6]
    assert list(np.flatnonzero(f["stuck"])) == list(range(20, 28))
    assert set(np.flatnonzero(f["clock"])) == {50, 51, 70, 80} or set(np.flatnonzero(f["clock"])) == {50, 70, 80, 51}


def test_forest_puts_outliers_first():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    x[7] = 12
    s = spikes.isolation_scores(x, 1)
    assert s.argmax() == 7 and ((0 < s) & (s < 1)).all()
    assert (spikes.isolation_scores(np.ones((50, 3)), 1) > 0).all()


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_short_series(n):
    raw, t = series(8)
    f = judge(raw[:n], t[:n])
    assert not f["spike"].any() and len(f["score"]) == n


def _rows(raw, t, sid=1, start=0):
    return [(sid, start + i, "s1", "c1", None if v is None else float(v), float(x), "extra") for i, (v, x) in enumerate(zip(raw, t))]


SCHEMA = "series_id long, bin_idx int, sample_id string, channel_name string, raw_median double, bin_time double, maximum string"


def tables(spark, rows):
    samples = spark.createDataFrame([("s1", "g1"), ("s1", "g1"), ("s2", None)], "sample_id string, group_id string")
    channels = spark.createDataFrame([("g1", "c1", 5000.0), ("g1", "c1", 5000.0), ("g1", "c2", None)], "group_id string, channel_name string, maximum float")
    return spark.createDataFrame(rows, SCHEMA), samples, channels


def test_table(spark):
    raw, t = series()
    raw[30], raw[50] = 3000, 6000
    rows = _rows(raw, t)
    rows[70] = (1, 70, "s1", "c1", None, float(t[70]), "extra")
    rows += rows[:5] + [(None, 1, "s1", "c1", -1.0, 1.0, "x"), (1, None, "s1", "c1", -1.0, 1.0, "x")]
    got = sorted(r["bin_idx"] for r in spikes.implausible_bins(*tables(spark, rows)).collect())
    assert got == [30, 50]
    series_df, samples, channels = tables(spark, rows)
    assert spikes.implausible_bins(series_df.limit(0), samples, channels).count() == 0
    # an unknown channel has no limit of its own, but the spike remains one
    assert 50 in [r["bin_idx"] for r in spikes.implausible_bins(series_df, samples.limit(0), channels).collect()]


def test_the_forest_decides(monkeypatch):
    raw, t = series(400, 5)
    raw[[50, 51, 200]] += 700
    f = judge(raw, t)
    assert list(np.flatnonzero(f["spike"])) == [50, 51, 200]
    assert (f["score"] < spikes.SUSPECT).mean() > 0.9  # few readings are looked at more closely
    monkeypatch.setattr(spikes, "score", lambda x, s, f: np.full(len(x), 0.4))
    assert not judge(raw, t)["spike"].any()


def test_series_together_as_alone():
    parts = [series(n, n) for n in (5, 40, 120, 300)]
    for raw, _ in parts:
        raw[len(raw) // 2] *= 3
    sid = np.concatenate([np.full(len(r), 10 + i) for i, (r, _) in enumerate(parts)])
    raw, t = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    one = np.ones(len(raw), bool)
    bins = np.concatenate([np.arange(len(p[0])) for p in parts])
    both = spikes.judge_all(sid, bins, raw, t, one, one, np.full(len(raw), 8192.0))
    at = 0
    for i, (r, u) in enumerate(parts):
        o = np.ones(len(r), bool)
        alone = spikes.judge(r, u, o, o, 8192.0, 10 + i)
        for k, v in alone.items():
            assert np.array_equal(v, both[k][at : at + len(r)], equal_nan=v.dtype == float), k
        at += len(r)


def test_blocks_of_long_series(spark):
    raw, t = series(1000)
    at = [255, 256, 257, 511, 700]
    for i in at:
        raw[i] += 900
    raw[600:610] = raw[600]
    quiet, t2 = series(1200, 8, sd=10)
    quiet[600:] += np.random.default_rng(9).normal(0, 120, 600)  # a noisy second half, so that the whole has a large scatter
    quiet[100] += 120  # far for its block, not for its series
    noise = np.random.default_rng(10)
    season, t3 = 1000 + 200 * np.sin(np.arange(900) * 2 * np.pi / 12) + noise.normal(0, 10, 900), np.cumsum(noise.uniform(800, 1200, 900))
    rows = _rows(raw, t) + _rows(quiet, t2, 2) + _rows(season, t3, 3) + _rows(*series(30, 4), 4)
    rows += rows[:3]
    df, samples, channels = tables(spark, rows)
    limits = spikes.channel_limits(samples, channels)
    whole = {(r["series_id"], r["bin_idx"]): r for r in spikes.judge_series(df, limits).collect()}
    cut = {(r["series_id"], r["bin_idx"]): r for r in spikes.judge_series(df, limits, whole=100, block=256).collect()}
    assert set(whole) == set(cut) and len(cut) == 1000 + 1200 + 900 + 30
    assert sorted(b for (s, b), r in cut.items() if s == 1 and (r["is_spike"] or r["is_stuck"])) == sorted(at + list(range(600, 610)))
    for k, r in whole.items():
        assert [r[f] for f in ("is_limit", "is_stuck", "is_spike", "is_clock")] == [cut[k][f] for f in ("is_limit", "is_stuck", "is_spike", "is_clock")]
        # levels at the very border of a block's halo aside, scores are those of the whole series
        assert abs(r["score"] - cut[k]["score"]) < 0.05
    assert not cut[2, 100]["is_spike"]
