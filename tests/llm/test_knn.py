import tracemalloc

import numpy as np
import pyarrow.parquet as pq
import pytest

from cytora.llm import knn


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    base = rng.lognormal(0, 1, (1500, 16))
    near = base[:200] * rng.normal(1, 0.02, (200, 16))
    x = np.concatenate([base, near, near[:50]])  # the last fifty are exact copies
    scale = 10.0 ** rng.uniform(-1, 3, len(x))
    rows = [(i + 1, [float(v) for v in x[i] * scale[i]], "clash", 1.0) for i in range(len(x))]
    bad = [(9001, None, "x", 1.0), (9002, [0.0] * 16, "x", 1.0), (9003, [float("nan")] * 16, "x", 1.0), (9004, [1.0] * 3, "x", 1.0), (None, [1.0] * 16, "x", 1.0)]
    df = spark.createDataFrame(rows + rows[:20] + bad, "vec_id long, detector_values array<float>, other string, similarity double")
    f = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    return df, f / np.linalg.norm(f, axis=1, keepdims=True)


def brute(u, k, least=None):
    s = u @ u.T
    np.fill_diagonal(s, -2)
    out = {}
    for i in range(len(u)):
        order = np.lexsort((np.arange(len(u)), -np.round(s[i], 7)))[:k]
        out[i + 1] = [(int(j) + 1, s[i, j]) for j in order if least is None or s[i, j] >= least]
    return out


def test_pairs_are_complete(data):
    df, u = data
    want = {(min(a, b), max(a, b)) for a, r in brute(u, 5, 0.99).items() for b, _ in r}
    got = {tuple(r) for r in knn.similar_pairs(df).collect()}
    assert got == want


def test_small_cells_lose_nothing(data):
    df, u = data
    rows = knn.neighbours(df, 5, 0.97, cell=40).collect()
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], []).append(r["similarity"])
    want = brute(u, 5, 0.97)
    assert sum(map(len, got.values())) == sum(map(len, want.values()))
    for i, s in got.items():
        assert np.allclose(sorted(s), sorted(v for _, v in want[i]), atol=1e-5)


def test_dense_vectors_look_less_and_lose_nothing(data, spark):
    df, u = data
    sparse = {(r["vec_id"], r["other"]) for r in knn.neighbours(df, 5, 0.97, cell=40, many_looks=0).collect()}
    plain = {(r["vec_id"], r["other"]) for r in knn.neighbours(df, 5, 0.97, cell=40).collect()}
    assert sparse == plain
    rng = np.random.default_rng(5)
    ball = np.ones(12) + rng.normal(0, 0.004, (900, 12))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(ball, 1)]
    f = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    f /= np.linalg.norm(f, axis=1, keepdims=True)
    got = {}
    for r in knn.neighbours(spark.createDataFrame(rows, "vec_id long, detector_values array<float>"), 5, 0.99, cell=30, many_looks=1).collect():
        got.setdefault(r["vec_id"], []).append(r["similarity"])
    for i, best in brute(f, 5).items():
        assert np.allclose(sorted(got[i]), sorted(v for _, v in best), atol=1e-6)


def test_recall_without_least(data):
    df, u = data
    q = df.filter("vec_id % 20 = 0")
    rows = knn.neighbours(df, 5, queries=q, cell=50).collect()
    want = brute(u, 5)
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], set()).add(r["other"])
    assert set(got) == {i for i in want if i % 20 == 0}
    hits = sum(len(got[i] & {j for j, _ in want[i]}) for i in got)
    assert hits >= 0.9 * 5 * len(got)


@pytest.mark.parametrize("settings", [{"fan": 4}, {"fan": 4, "many_looks": 0}, {"most_cells": 6}, {"most_cells": 6, "fan": 2, "many_looks": 0}])
def test_trees_and_parts_lose_nothing(data, settings):
    df, u = data
    for asked in (None, df.filter("vec_id % 3 = 0")):
        got = {}
        for r in knn.neighbours(df, 5, 0.97, queries=asked, cell=60, **settings).collect():
            got.setdefault(r["vec_id"], []).append(r["similarity"])
        want = {i: b for i, b in brute(u, 5, 0.97).items() if b and (asked is None or i % 3 == 0)}
        assert set(got) == set(want)
        for i, b in want.items():
            assert np.allclose(sorted(got[i]), sorted(v for _, v in b), atol=1e-5)


@pytest.mark.parametrize("settings", [{"fan": 8}, {"most_cells": 10}])
def test_recall_of_trees_and_parts(data, settings):
    df, u = data
    got = {(r["vec_id"], r["other"]) for r in knn.neighbours(df, 5, queries=df.filter("vec_id % 10 = 0"), cell=60, **settings).collect()}
    want = {(i, j) for i, b in brute(u, 5).items() if i % 10 == 0 for j, _ in b}
    assert len(got & want) >= 0.9 * len(want)


def test_recall_does_not_fall_with_the_number_of_cells():
    t = pq.read_table("/root/testdata/sf0.1/spectral_events.parquet", columns=["vec_id", "detector_values"])
    ids, x = knn.unit_rows(t.column("vec_id").to_numpy(), knn._list_array(t.column("detector_values")), 32)
    x = x[np.random.default_rng(6).permutation(np.unique(ids, return_index=True)[1])]
    s = x[:200] @ x.T
    s[np.arange(200), np.arange(200)] = -2
    near = np.argpartition(-s, 9, axis=1)[:, :10]
    for cells, nodes in ((50, 1), (500, 8), (2000, 40)):
        if nodes == 1:
            tree = knn.Tree(np.zeros((1, 32), dtype=np.float32), [knn.centroids(x, cells)])
        else:
            top = knn.centroids(x, nodes)
            node = (x @ top.T - 0.5 * (top * top).sum(axis=1)).argmax(axis=1)
            tree = knn.Tree(top, [knn.centroids(x[node == n], max(1, round((node == n).mean() * cells))) for n in range(nodes)])
        own = np.concatenate([tree.home(part)[1] for part in np.array_split(x, 10)])
        home = tree.home(x[:200])
        reach = np.empty(200, dtype=np.float32)
        for i in range(200):
            best = np.sort(s[i, own == home[1][i]])[::-1][:10]
            reach[i] = knn.SHORTER * np.sqrt(2 - 2 * best[-1])
        at, other = tree.looks(x[:200], *home, reach, reach)
        seen = {*zip(range(200), home[1].tolist()), *zip(at.tolist(), other.tolist())}
        assert np.mean([(i, own[j]) in seen for i in range(200) for j in near[i]]) >= 0.96


def test_hot_copies(spark):
    rng = np.random.default_rng(1)
    one = [float(v) for v in rng.uniform(1, 2, 8)]
    rows = [(i, one) for i in range(1, 301)] + [(1000, [v * 1.001 if j else v for j, v in enumerate(one)])] + [(2000 + i, [float(v) for v in rng.lognormal(0, 2, 8)]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, detector_values array<float>")
    got = {tuple(r) for r in knn.similar_pairs(df).collect()}
    split = {tuple(r) for r in knn.neighbours(df, 5, 0.99, copies=100).select("vec_id", "other").collect()}
    split = {(min(p), max(p)) for p in split}
    members = set(range(1, 301))
    for pairs in (got, split):
        degree = {i: 0 for i in members}
        for a, b in pairs:
            for v in (a, b):
                if v in degree:
                    degree[v] += 1
        assert min(degree.values()) >= 5
    assert any(1000 in p for p in split)


def test_hot_copies_of_bad_vectors_are_left_out(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(v) for v in rng.lognormal(0, 1, 8)]) for i in range(1, 401)]
    bad = [[0.0] * 8, [float("nan")] * 8, [1.0] * 7 + [float("inf")], [1.0] * 3]
    rows = good + [(1000 * (b + 1) + i, x) for b, x in enumerate(bad) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, detector_values array<float>")
    for q in (None, df):
        got = knn.neighbours(df, 5, 0.9, copies=100, queries=q).collect()
        assert got and max(max(r["vec_id"], r["other"]) for r in got) <= 400


@pytest.mark.parametrize("noise", [0, 1e-6])
def test_a_third_of_the_vectors_point_the_same_way(spark, monkeypatch, noise):
    rng = np.random.default_rng(8)
    one = rng.lognormal(0, 1, 16)
    x = np.concatenate([rng.lognormal(0, 1, (1200, 16)), one * rng.normal(1, noise, (600, 16)) * 10.0 ** rng.uniform(-1, 3, (600, 1))]).astype(np.float32)
    df = spark.createDataFrame([(10 * (i + 1), [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, detector_values array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    placed, hashed = [], knn.hashed
    monkeypatch.setattr(knn, "BLOCK", 120)
    monkeypatch.setattr(knn, "hashed", lambda d, *keys, **kw: (placed.append(d), hashed(d, *keys, **kw))[1])
    for least, asked in ((0.9, None), (None, df.filter("vec_id % 70 = 0"))):
        got = {}
        for r in knn.neighbours(df, 5, least, queries=asked, cell=300, shorter=1.0).collect():
            got.setdefault(r["vec_id"] // 10, []).append(r["similarity"])
        want = {i: b for i, b in brute(u, 5, least).items() if b and (asked is None or i % 7 == 0)}
        assert set(got) == set(want)
        for i, b in want.items():
            assert np.allclose(sorted(got[i]), sorted(v for _, v in b), atol=1e-5)
        held = placed[-1].filter("role = 0").groupBy("cell", "block").count().toPandas()
        assert held["count"].sum() == len(x) and held["count"].max() < 1.4 * 120


def test_a_search_keeps_few_pairs():
    rng = np.random.default_rng(9)
    x = (np.ones(16) + rng.normal(0, 1e-4, (3000, 16))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(3000)
    search = knn.Search(ids, x, x.mean(axis=0), knn.rotation(16, 64), 5, 0.99, True)
    tracemalloc.start()
    found = [*search.run(ids, x)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 9_000_000 * 24 / 2  # of all pairs
    exact = x.astype(float) @ x.T.astype(float)
    np.fill_diagonal(exact, -2)
    want = np.sort(np.partition(exact, -5, axis=1)[:, -5:], axis=None)
    for s in (np.concatenate([f[2] for f in found]), search.back()[2]):
        assert np.allclose(np.sort(s), want, atol=1e-12)


@pytest.mark.parametrize("many_looks", [0, 32])
def test_members_and_visitors_of_a_block(many_looks):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.lognormal(0, 0.5, (700, 12)), np.ones((300, 12)) + rng.normal(0, 0.01, (300, 12)), np.ones((20, 12))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids = rng.permutation(len(x))
    member = rng.random(len(x)) < 0.6
    s = x.astype(float) @ x.T.astype(float)
    np.fill_diagonal(s, -2)
    visitors = np.array_split(np.flatnonzero(~member), 3)
    for least in (0.99, 0.8):
        join = knn.Join(ids[member], x[member], 5, least, fine=40, many_looks=many_looks)
        got = {}
        for found in (*[join.visit(ids[v], x[v]) for v in visitors], join.run()):
            for i, j, v in zip(*found):
                assert i != j
                got.setdefault(int(i), []).append(v)
        for n, i in enumerate(ids):
            seen = s[n] if member[n] else s[n][member]
            best = np.sort(seen[seen >= least])[::-1][:5]
            assert np.allclose(got.get(int(i), []), best, atol=1e-9)


def test_ties_of_equal_vectors_go_to_the_smaller_id_in_any_cells():
    rng = np.random.default_rng(12)
    x = np.repeat(np.ones((120, 32)) + rng.normal(0, 0.02, (120, 32)), 10, axis=0)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    for fine in (25, 90, 2000):
        order = rng.permutation(len(x))
        i, j, _ = knn.Join(order, x[order], 5, 0.99, fine=fine).run()
        assert all(j[i == n].tolist() == [m for m in range(n - n % 10, n - n % 10 + 10) if m != n][:5] for n in range(len(x)))


def test_vectors_move_once_and_seldom_look_across_borders(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.1/spectral_events.parquet").select("vec_id", "detector_values").crossJoin(spark.range(8)).selectExpr("vec_id * 8 + id AS vec_id", "detector_values")
    placed, hashed = [], knn.hashed
    monkeypatch.setattr(knn, "hashed", lambda d, *keys, **kw: (placed.append(d), hashed(d, *keys, **kw))[1])
    knn.similar_pairs(df)
    moved = dict(placed[-1].groupBy("role").count().collect())
    assert len(placed) == 1 and moved[1] < 1.5 * moved[0]
    assert knn.wide_cell(10**6, 6) == 10**6 // 48 and knn.wide_cell(10**9, 6) == knn.WIDE and knn.wide_cell(100, 6) == knn.CELL


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 24)).astype(np.float32)
    q = rng.normal(size=(50, 24)).astype(np.float32)
    c = np.zeros(24, dtype=np.float32)
    exact = ((q[:, None, :] - x[None]) ** 2).sum(2)
    for bits in (64, 256):
        turn = knn.rotation(24, bits)
        assert np.allclose(turn.T @ turn, np.eye(24), atol=1e-5)
        low, high = knn.Codes(x, c, turn).bounds(q, c, turn)
        assert ((exact >= low) & (exact <= high)).mean() > 0.99
        assert abs(((low + high) / 2 - exact).mean()) < 0.05 * exact.mean()


def test_a_truncated_array_comes_first(spark):
    rng = np.random.default_rng(10)
    x = rng.lognormal(0, 0.3, (60, 8))
    rows = [(i, [1.0] * 3) for i in (1, 2)] + [(3, [])] * 200 + [(i, [float(v) for v in r]) for i, r in enumerate(x, 10)]
    df = spark.createDataFrame(rows, "vec_id long, detector_values array<float>").coalesce(1)
    got = knn.neighbours(df, 5).collect()
    assert {r["vec_id"] for r in got} == set(range(10, 70)) and len(got) == 300


def test_empty(data):
    df, _ = data
    assert knn.similar_pairs(df.limit(0)).count() == 0
    assert knn.similar_pairs(df.filter("vec_id = 9002")).count() == 0
    assert knn.similar_pairs(df.filter("vec_id = 1")).count() == 0
