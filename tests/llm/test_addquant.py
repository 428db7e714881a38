"""Additive quantisation: recall against brute force, exact scores, odd rows."""

import numpy as np
import pytest

from weftlake.llm import addquant as A


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(A, "CODE_BLOCK", 500)
    monkeypatch.setattr(A, "QUERY_BLOCK", 10)
    monkeypatch.setattr(A, "train", lambda x, books=8, words=64, f=A.train: f(x, books, words))


def brute(rows, k=5, every=50):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], float)
    x = x / np.sqrt((x * x).sum(1, keepdims=True))
    out = {}
    for n, i in enumerate(ids):
        if i % every == 0:
            s = x @ x[n]
            near = sorted((-round(float(s[m]), 12), j) for m, j in enumerate(ids) if j != i)[:k]
            out[i] = [(j, -d) for d, j in near]
    return out


def test_recall_and_scores(spark, small):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 24))
    x = centres[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 24)) * 0.7
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    got = {}
    for r in A.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want, hits = brute(rows), 0
    assert set(got) == set(want)
    by = dict(rows)
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and q not in [v for _, v, _ in found]
        a = np.array(by[q])
        for _, v, s in found:
            b = np.array(by[v])
            assert abs(s - a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) < 1e-12
        assert [s for _, _, s in found] == sorted((s for _, _, s in found), reverse=True)
        hits += len({v for _, v, _ in found} & {j for j, _ in want[q]})
    assert hits / (5 * len(want)) >= 0.9


def test_copies_ties_and_odd_vectors(spark, small):
    rng = np.random.default_rng(9)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 400)] + [(i, rng.normal(size=3).tolist()) for i in range(400, 600)]
    odd = [(1000, None), (1050, [0.0, 0.0, 0.0]), (1100, [1.0, None, 2.0]), (1150, [float("nan"), 1.0, 1.0]), (1200, [float("inf"), 1.0, 1.0]), (1250, []), (1300, [1.0, 2.0]), (1301, [2.0, 1.0]), (1302, [-1.0, 1.0]), (650, [3.0, 1.0, 2.0]), (650, [1.0, 2.0, 3.0]), (None, [1.0, 1.0, 1.0]), (7, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, rank int").repartition(3)
    got = {}
    for r in A.neighbours(df).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == [0, 1, 2, 3, 4] and got[350] == [0, 1, 2, 3, 4]
    assert set(got) == {*range(0, 600, 50), 650, 1300} and got[1300] == [1301, 1302] and got[650] == [0, 1, 2, 3, 4]
    assert A.neighbours(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in A.neighbours(few).collect()) == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]


def test_beam_is_no_worse_than_greedy():
    rng = np.random.default_rng(2)
    x = A._unit(rng.normal(size=(800, 16)))
    books = A.train(x, 4, 16)
    error = lambda beam: ((x - A.decode(A.encode(x.astype(np.float32), books, beam), books)) ** 2).sum()
    assert error(8) <= error(1)


@pytest.mark.parametrize("kind", ["isotropic", "clustered"])
def test_recall_at_production_settings(spark, kind):
    rng = np.random.default_rng(21)
    n, d = 30_000, 128
    x = rng.normal(size=(n, d)).astype(np.float32)
    if kind == "clustered":  # thousands of near-equal vectors in a few of the clusters
        at = rng.zipf(1.5, n) % 40
        x = (3 * rng.normal(size=(40, d))[at] + rng.normal(size=(n, d)) * np.where(at < 3, 0.02, 0.5)[:, None]).astype(np.float32)
    import pyarrow as pa

    table = pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), d).cast(pa.list_(pa.float32()))})
    got = {}
    for r in A.neighbours(spark.createDataFrame(table).repartition(8)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u = A._unit(x.astype(np.float64))
    near = u[::50] @ u.T
    near[np.arange(n // 50), np.arange(0, n, 50)] = -2
    best = np.argsort(-near, axis=1, kind="stable")[:, :5]
    hits = sum(len(got[q * 50] & set(b.tolist())) for q, b in enumerate(best))
    print(kind, hits / best.size)
    assert hits / best.size >= 0.95


def test_answers_come_from_the_scan_alone(spark, small, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 12)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert A.neighbours(df).count() == 40
    monkeypatch.setattr(A, "scan", lambda q, least, books, allowed, k, chunks, reranked=None: [A.Best(least[:10], k)])
    assert A.neighbours(df).count() == 0


@pytest.mark.parametrize("n", [900, 3000])
def test_few_candidates_are_reranked(n, monkeypatch):
    """Below and above the sample's size."""
    monkeypatch.setattr(A, "SAMPLE", 1500)
    rng = np.random.default_rng(6)
    x = A._unit(rng.normal(size=(60, 32))[rng.integers(0, 60, n)] + 0.4 * rng.normal(size=(n, 32)))
    s = rng.choice(n, min(n, A.SAMPLE), replace=False)
    books = A.train(x[s])
    codes = A.encode(x.astype(np.float32), books)
    norm, fit = A.described(x, codes, books)
    allowed = A.calibrate(x[s], codes[s], norm[s], fit[s], books, 5)
    own = np.arange(0, n, 50)
    least = A.thresholds(x[own], own, x[s].astype(np.float32), s, codes[s], norm[s], fit[s], books, 6)
    counted = []
    (best,) = A.scan(x[own], least, books, allowed, 6, [(np.arange(n), x, codes, norm, fit)], counted)
    near = x[own] @ x.T
    near[np.arange(len(own)), own] = -2
    top = np.argsort(-near, axis=1)[:, :5]
    hits = sum(len(set(best.id[best.query == q].tolist()) & set(t.tolist())) for q, t in enumerate(top))
    assert hits / top.size >= 0.95 and sum(counted) < 0.2 * n * len(own)


def test_extreme_finite_values(spark, small):
    rows = [(50 * i, [a, b, c]) for i, (a, b, c) in enumerate([(1e200, 2e200, 0.0), (1e-200, 2e-200, 1e-210), (5e-324, 0.0, 0.0), (-1.7e308, 1.7e308, 1.7e308), (1.0, 1.0, 1.0)])]
    got = A.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 20 and all(-1 - 1e-12 <= r.score <= 1 + 1e-12 for r in got)
    assert [r.vec_id for r in got if r.query_id == 0 and r.rank == 1] == [50]
