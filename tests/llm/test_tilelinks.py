"""Tile links: bounds, links and components against brute force, odd rows."""

import duckdb
import numpy as np
import pytest

from weftlake.llm import tilelinks as T


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(T, "BLOCK_BYTES", 8 * 24 * 70)
    monkeypatch.setattr(T, "TILE_ROWS", 16)


def brute(x, ids):
    u = x / np.abs(x).max(1, keepdims=True)
    u = u / np.sqrt((u * u).sum(1, keepdims=True))
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(x)).min(1))
        if (new == label).all():
            return {i: (int(n), ids[c]) for i, n, c in zip(ids, near.sum(1), label)}
        label = new


def test_bounds_hold_and_only_open_pairs_are_computed():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 24)) * 10.0 ** rng.integers(-150, 150, (60, 1))
    x[30:] = x[:30] + rng.normal(size=(30, 24)) * np.abs(x[:30]).max(1, keepdims=True) * rng.uniform(0, 0.4, (30, 1))
    block = T.Block(np.arange(60), np.ones(60, np.int64), x)
    exact = (block.x @ block.x.T) / np.sqrt(np.outer(block.square, block.square))
    near = T.products(block.q, block.q) * np.outer(block.step, block.step)
    assert (np.abs(near - exact) <= block.length[:, None] * block.error + block.error[:, None] + 1e-12).all()
    computed = []
    found = {(int(a), int(b)) for i, j in T.tile_links(block, block, True, computed=computed) for a, b in zip(i, j)}
    assert found == {(i, j) for i in range(60) for j in range(i + 1, 60) if exact[i, j] >= 0.9}
    assert 0 < len(found) and sum(computed) < 0.2 * len(found) + 30  # far from all 1,770 pairs


def test_long_vectors_are_exact():
    a = np.full((2, 3000), 127, np.int8)
    assert (T.products(a, a) == 3000 * 127 * 127).all()


def test_against_brute_force(spark, small):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 24))
    x = np.concatenate([base, base[:60] + rng.normal(size=(60, 24)) * 0.35, base[0] + rng.normal(size=(150, 24)) * 0.3, np.repeat(base[1:2], 150, 0) * 2.0, np.repeat(base[2:3], 40, 0)])
    x[-20:] *= 1e200
    x[:5] *= 1e-200
    ids = rng.permutation(5 * len(x))[: len(x)].tolist()
    order = np.argsort(ids)
    x, ids = x[order], sorted(ids)
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in zip(ids, x)], "vec_id long, embedding array<double>, set_id string").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in T.near_duplicates(df).collect()}
    assert got == brute(x, ids)
    assert len({c for _, c in got.values()}) < len(ids) - 300


def test_same_in_sql(spark, small):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 8))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 8)) * 0.3, base[:1].repeat(10, 0)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [0.0] * 8), (202, [1.0, None] + [0.0] * 6)]
    got = sorted(tuple(r) for r in T.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    con = duckdb.connect()
    con.execute("create table embeddings(vec_id bigint, embedding double[])")
    con.executemany("insert into embeddings values (?, ?)", rows)
    assert got == sorted(con.execute(T.ORACLE).fetchall())


def test_odd_rows(spark):
    rows = [(3, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [2.0, 0.1]), (None, [1.0, 0.01]), (None, [0.0, 1.0]), (9, None), (8, []), (7, [0.0, 0.0]), (6, [float("nan"), 1.0]), (5, [1.0, None]), (4, [1.0]), (1, [-0.0, 1.0])]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in T.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    assert got == sorted([(3, 3, 2, False)] * 2 + [(2, 3, 2, True), (None, 3, 2, False), (None, 1, 1, False), (1, 1, 1, True)] + [(i, 0, i, True) for i in (9, 8, 7, 6, 5, 4)], key=str)
    alone = T.near_duplicates(spark.createDataFrame([(None, [1.0]), (None, [2.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r.n_links, r.component_id, r.kept) for r in alone] == [(1, None, True)] * 2


def test_empty(spark):
    got = T.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert got.collect() == [] and got.columns == ["vec_id", "n_links", "component_id", "kept"]
