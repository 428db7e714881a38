"""Whitening: exact scatters, components against plain numpy, odd rows."""

import numpy as np
import pytest

from weftlake.llm import whitening as W


def plain(rows):
    x = np.array([np.floor(256 * np.asarray(v, float)) for _, v in rows]).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    cov = (n * (u.T @ u) - np.outer(s, s)) / n**2
    values, vectors = np.linalg.eigh(cov)
    return x, n, s, values[::-1], vectors[:, ::-1], np.trace(cov)


@pytest.mark.parametrize("bits", [1, 7, 30, 45, 60])
def test_scatter_is_exact(bits):
    rng = np.random.default_rng(bits)
    x = rng.integers(-(1 << bits), 1 << bits, (131, 5), dtype=np.int64)
    y = x.astype(object)
    assert (W.scatter(x) == y.T @ y).all()
    values = W.scatter(x).ravel()
    back = sum(part.astype(object) << (32 * k) for k, part in enumerate(W.limbs(values)))
    assert (back == values).all()


def test_one_row_and_constant_columns():
    x = np.array([[3, -7, 0]])
    assert (W.scatter(x) == np.outer(x[0], x[0])).all()
    assert (W.scatter(np.zeros((0, 2), np.int64)) == 0).all()


def test_against_plain(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 10)) * np.linspace(1, 3, 10) @ np.linalg.qr(rng.normal(size=(10, 10)))[0]
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(i, base[7].tolist()) for i in range(300, 450)]  # a third is one vector
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<double>, component int").repartition(4)
    got = {(r.vec_id, r.component): r for r in W.whiten(df).collect()}
    x, n, s, values, vectors, trace = plain(rows)
    assert n == 300 and len(got) == 4 * len(rows)
    y = (x - s / n) @ vectors[:, :4] / np.sqrt(values[:4])
    for k in range(4):
        mine = np.array([got[i, k + 1].whitened for i, _ in rows])
        assert np.abs(mine * np.sign(mine @ y[:, k]) - y[:, k]).max() < 1e-9
    far = ((n * x - s) ** 2).sum(1)
    for at, (i, _) in enumerate(rows):
        r = got[i, 1]
        assert r.n == n and r.deviation == far[at] and abs(r.explained - values[0] / trace) < 1e-12 and r.identity_error < 1e-9


def test_wrong_components_show_in_the_error(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(50, 6)) * np.arange(1, 7))], "vec_id long, embedding array<double>")
    monkeypatch.setattr(np.linalg, "eigh", lambda c: (np.diag(c).copy(), np.eye(len(c))))
    assert W.whiten(df).first().identity_error > 0.01


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (None, [2.0, 1.0]), (1, [0.0, 0.5]), (2, [-1.0, -0.001]), (3, None), (4, []), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1e300, 0.0])]
    rows += [(20, [5.0]), (21, [5.0]), (30, [1.0, 1.0, 1.0]), (31, [3.0e15, -3.0e15, 1.0]), (32, [0.0, 0.0, 7.0])]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    two = [r for r in got if r.n == 4]
    assert len(two) == 8 and sorted((r.vec_id or 0) for r in two) == [0, 0, 1, 1, 1, 1, 2, 2]
    one = [r for r in got if r.vec_id in (20, 21)]
    assert len(one) == 2 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error is None for r in one)
    three = {(r.vec_id, r.component): r for r in got if r.vec_id >= 30} if None not in [r.vec_id for r in got] else {(r.vec_id, r.component): r for r in got if (r.vec_id or 0) >= 30}
    assert len(three) == 9 and three[31, 1].deviation is None and three[31, 3].whitened is None  # three points have two components
    assert not {3, 4, 5, 6, 7, 8} & {r.vec_id for r in got}


def test_empty(spark):
    got = W.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
