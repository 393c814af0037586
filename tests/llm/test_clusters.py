import numpy as np
import pytest

from cytora.llm import clusters

CH = "group_id string, channel_idx int, channel_name string, channel_kind string, gain string"
EV = "event_id long, group_id string, event_values array<float>, cluster_id string"


def group(seed, sizes, d=6, noise=8):
    """Events of populations at three levels per channel, and noise events at random levels."""
    rng = np.random.default_rng(seed)
    levels = np.array([0.2, 2.8, 5.4])
    seen, x, y = set(), [], []
    for k, n in enumerate(sizes):
        while (p := tuple(rng.integers(0, 3, d))) in seen:
            pass
        seen.add(p)
        x.append(levels[list(p)] + rng.normal(0, 0.3, (n, d)))
        y += [k] * n
    x.append(rng.uniform(-1, 7, (noise, d)))
    y += [-1] * noise
    return np.sinh(np.concatenate(x)) * 150, np.array(y)


@pytest.fixture(scope="module")
def tables(spark):
    a, ya = group(1, [300, 120, 40, 25])
    b, yb = group(2, [60, 12])
    rng = np.random.default_rng(3)
    rows, truth, i = [], {}, 0
    for g, x, y in (("a", a, ya), ("b", b, yb)):
        for k in rng.permutation(len(x)):
            i += 1
            rows.append((i, g, [float(v) for v in x[k]] + [float(rng.uniform(0, 1e5))], "clash"))
            truth[i] = (g, int(y[k]))
    rows += rows[:10]
    rows += [(9001, "a", None, "x"), (9002, "a", [1.0], "x"), (9003, "a", [float("nan")] * 7, "x"), (9004, None, [1.0] * 7, "x"), (None, "a", [1.0] * 7, "x"), (9005, "unknown", [1.0] * 7, "x")]
    chans = [(g, j, f"D{j}", "Optical" if j else None, "x") for g in "ab" for j in range(6)] + [(g, 6, "Time", "Time", "x") for g in "ab"]
    return spark.createDataFrame(rows, EV), spark.createDataFrame(chans + chans[:3], CH), truth


def expected(truth):
    members = {}
    for i, key in truth.items():
        members.setdefault(key, set()).add(i)
    return {frozenset(m) for (g, k), m in members.items() if k >= 0 and len(m) >= clusters.MIN_EVENTS}


def found(rows):
    out = {}
    for r in rows:
        out.setdefault(r["cluster_id"], set()).add(r["event_id"])
    assert all(k == min(m) for k, m in out.items())
    return out


@pytest.mark.parametrize("hot", [clusters.HOT_ROWS, 200])
def test_populations(tables, hot):
    events, channels, truth = tables
    rows = clusters.populations(events, channels, hot_rows=hot).collect()
    assert len({r["event_id"] for r in rows}) == len(rows)
    got = found(rows)
    want = expected(truth)
    assert len(got) == len(want)
    for w in want:
        best = max(got.values(), key=lambda m: len(m & w))
        assert len(best & w) >= 0.97 * len(w) and len(best - w) <= 2


def test_hot_groups_agree_with_whole_ones(tables):
    events, channels, _ = tables
    whole = {r["event_id"]: r["cluster_id"] for r in clusters.populations(events, channels).collect()}
    split = {r["event_id"]: r["cluster_id"] for r in clusters.populations(events, channels, hot_rows=100).collect()}
    assert len(set(whole.items()) ^ set(split.items())) <= 0.01 * len(whole)


def test_describe(tables):
    events, channels, _ = tables
    assigned = clusters.populations(events, channels)
    rows = clusters.describe(assigned, 3).collect()
    sizes = {r["cluster_id"]: r["events"] for r in rows}
    want = found(assigned.collect())
    assert sizes == {k: len(v) for k, v in want.items()}
    assert all(len(r["typical"]) == 3 and set(r["typical"]) <= want[r["cluster_id"]] for r in rows)


def test_empty(tables):
    events, channels, _ = tables
    assert clusters.found(events.limit(0), channels).count() == 0
    assert clusters.found(events, channels.limit(0)).count() == 0


def test_equal_events_form_a_population(spark):
    ch = spark.createDataFrame([("g", 0, "D1", "Optical", "x"), ("g", 1, "D2", "Optical", "x")], CH)
    ev = spark.createDataFrame([(i, "g", [5.0, 7.0], "x") for i in range(30)], EV)
    assert {(r[0], r[1]) for r in clusters.found(ev, ch).collect()} == {(i, 0) for i in range(30)}


def test_kinds():
    from cytora.operators.channels import channel_kind as k

    assert [k(None, n) for n in ("Time", "FSC-A", "BCKG190Di", "Width", "Event_length", "Nd142Di", "142Nd", "B525-A")] == ["Time", "Scatter", "Background", "Model", "Model", "Mass", "Mass", "Optical"]
    assert k("Spectrum", "Time") == "Spectrum"


def test_small_population_in_a_large_group():
    rng = np.random.default_rng(11)
    levels = np.array([[0.2, 0.2, 2.8, 2.8, 0.2, 2.8], [0.2, 2.8, 0.2, 2.8, 2.8, 0.2], [0.2, 2.8, 2.8, 0.2, 0.2, 0.2]])
    rare = levels[0].copy()
    rare[0] = 5.4  # a level that no other event has on this channel
    y = np.concatenate([np.repeat(levels, 100_000, axis=0), np.repeat(rare[None], 40, axis=0)])
    y += rng.normal(0, 0.3, y.shape)
    part, _ = clusters.assign(clusters.fit_group(y), y)
    assert len(set(part[-40:])) == 1 and part[-1] >= 0
    assert (part[:-40] == part[-1]).sum() <= 2


def test_noise_makes_no_level():
    rng = np.random.default_rng(12)
    for n in (20, 200, 2000):
        x = np.concatenate([rng.normal(0, 0.3, 20_000), rng.uniform(-6, 8, n)])[:, None]
        assert len(clusters.valleys(clusters.histograms(x)[0])) == 0


def test_valleys():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.3, 500), rng.normal(3, 0.4, 60)])[:, None]
    (cut,) = clusters.valleys(clusters.histograms(x)[0])
    assert 0.9 < cut < 2.2
    assert clusters.valleys(clusters.histograms(rng.normal(0, 0.3, (500, 1)))[0]) == []


def test_components_are_split():
    """Two stripes side by side: on each channel they overlap, across them they are six standard deviations apart."""
    rng = np.random.default_rng(13)
    along, across = rng.normal(0, 2.0, 4000), rng.normal(0, 0.25, 4000) + np.repeat([-0.75, 0.75], 2000)
    stripes = 3 + np.column_stack([along + across, along - across]) / np.sqrt(2)
    for extra in (0, 3):  # alone, and with other channels, one of which has levels
        y = np.column_stack([stripes, rng.normal(2, 0.3, (4000, extra))])
        if extra:
            y[:, 2] += rng.integers(0, 2, 4000) * 3
        assert not any(len(clusters.valleys(c)) for c in clusters.histograms(y[:, :2]))
        model = clusters.fit_group(y)
        part, _ = clusters.assign(model, y)
        assert len(model.weights) == (4 if extra else 2)
        truth = np.repeat([0, 1], 2000)
        for k in np.unique(part[part >= 0]):
            assert max(np.bincount(truth[part == k])) >= 0.98 * (part == k).sum()
        assert (part >= 0).mean() > 0.99


def test_a_round_component_stays_whole():
    rng = np.random.default_rng(14)
    for n in (60, 600, 20_000):
        y = rng.normal(3, 0.4, (n, 5)) @ np.linalg.qr(rng.normal(size=(5, 5)))[0]
        assert len(clusters.fit_group(y).weights) == 1


def test_shares_of_a_group_add_up():
    x, _ = group(5, [400, 200, 90])
    y = np.arcsinh(x / 150)
    fit, parts = clusters.Fit(), np.array_split(y, 7)
    while fit.stage != "done":
        whole = clusters.gather(fit, y)
        added = clusters.add([clusters.gather(fit, p) for p in parts])
        assert all(np.allclose(whole[k], added[k]) for k in whole)
        fit = clusters.advance(fit, added)
    assert len(fit.model.weights) == 3
