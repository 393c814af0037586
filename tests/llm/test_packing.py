import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cytora.llm import packing


@given(st.lists(st.integers(0, 100), max_size=200))
@settings(max_examples=200, deadline=None)
def test_fill_keeps_every_item(sizes):
    bins = packing.fill(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins)


def test_local_search_empties_containers():
    import random

    random.seed(1)
    sizes = [random.randint(300, 1000) for _ in range(1500)]
    plain, free = packing.best_fit(sizes, 2048)
    before = sum(bool(b) for b in plain)
    squares = sum((2048 - f) ** 2 for f in free)
    packing.improve(plain, free, sizes, 2048)
    assert sum((2048 - f) ** 2 for f in free) > squares
    assert sum(bool(b) for b in plain) < before


@pytest.fixture(scope="module")
def docs(spark):
    words = "the laser was cleaned before every run and the valve stayed open "
    rows = [(i, words * (1 + i % 40), "clash") for i in range(1, 400)] + [(500, words * 900, "x"), (501, "", "x"), (502, None, "x"), (None, "a", "x"), (1, "again", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, place string"), rows


def test_containers(docs):
    df, rows = docs
    for chunk_bins in (2000, 4):
        packed = packing.containers(df, 512, chunk_bins=chunk_bins)
        got = packed.collect()
        enc = packing.encoding()
        want = sorted((d, len(enc.encode_ordinary(t))) for d, t, _ in rows if d is not None and t is not None)
        per = {}
        held = {}
        for r in got:
            per.setdefault((r["doc_id"], r["copy"]), []).append((r["piece"], r["first_token"], r["n_tokens"]))
            held.setdefault(r["container_id"], []).append((r["place"], r["n_tokens"]))
        assert sorted((d, sum(p[2] for p in ps)) for (d, _), ps in per.items()) == want
        for (d, _), ps in per.items():
            ps.sort()
            assert [p[1] for p in ps] == [512 * i for i in range(len(ps))]
            assert len(ps) == 1 or sum(p[2] for p in ps) > 512
        assert all(sum(n for _, n in c) <= 512 and sorted(p for p, _ in c) == list(range(len(c))) for c in held.values())
        report = packing.fill_report(packed, 512).first()
        assert report["containers"] == len(held) and report["fill"] > (0.97 if chunk_bins > 4 else 0.8)


def test_empty(docs):
    df, _ = docs
    assert packing.containers(df.limit(0)).count() == 0
    assert packing.containers(df.filter("doc_id = 501")).count() == 1


def test_local_search_closes_a_gap_that_best_fit_leaves():
    import numpy as np

    saved = 0
    for seed in (1, 5):
        sizes = np.clip(np.random.default_rng(seed).lognormal(6.5, 0.6, 3000).astype(int) + 1, 1, 2048).tolist()
        plain, free = packing.best_fit(sizes, 2048)
        before = sum(map(bool, plain))
        assert before > -(-sum(sizes) // 2048)
        packing.improve(plain, free, sizes, 2048)
        assert sorted(i for b in plain for i in b) == list(range(3000))
        assert [2048 - sum(sizes[i] for i in b) for b in plain] == free and min(free) >= 0
        saved += before - sum(map(bool, plain))
    assert saved >= 3
    pairs = [7, 7, 7, 6, 6, 6, 5, 5, 5, 5, 4, 4, 3, 3, 2, 2]  # of ten, as full as can be
    plain, free = packing.best_fit(pairs, 10)
    packing.improve(plain, free, pairs, 10)
    assert sum(map(bool, plain)) == -(-sum(pairs) // 10)
