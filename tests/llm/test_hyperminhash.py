"""HyperMinHash near-duplicates against brute force."""

from itertools import combinations

import numpy as np
import pytest

from weftlake.llm import hyperminhash as H
from weftlake.llm.textnum import shingle_sets

import re


def brute(rows):
    """doc_id -> (n_shingles, component) by all pairs."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            comp[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def planted(seed=5):
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(3000)]
    rows, i = [], 0
    for _ in range(40):
        base = list(rng.choice(vocab, int(rng.integers(1, 160))))
        for _ in range(int(rng.integers(1, 6))):
            t = base.copy()
            for _ in range(int(rng.integers(0, 1 + max(1, len(t) // 40)))):
                t[int(rng.integers(len(t)))] = str(rng.choice(vocab))
            rows.append((i, " ".join(t) if rng.random() < 0.7 else "\n ".join(t).upper()))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \t\n"), (i + 3, ""), (i + 4, "one Two"), (i + 5, "one  two"), (i + 6, "x " * 30_000)]
    return rows


def test_equals_brute_force(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in H.near_duplicates(df).collect()}
    want = brute(rows)
    assert got == want
    kept = {r.doc_id for r in H.deduplicate(df).select("doc_id").collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_null_ids_repeats_and_empty(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "only here now and then"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in H.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 3, False), (3, 3, True), (3, 3, True), (None, None, True), (7, 7, True)], key=str)
    assert H.near_duplicates(df.limit(0)).count() == 0


def test_estimate_is_corrected():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    a = np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
    b = np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
    j, used = H.estimate(H.registers(a)[None], H.registers(b)[None], np.array([len(a)]), np.array([len(b)]))
    assert used[0] == 128 and abs(j[0] - 0.75) < 0.15
    assert H.expected_collisions(np.array([1e5]), np.array([1e5]))[0] == pytest.approx(0.17 * 2.0**-10, rel=0.3)


def test_short_texts_are_one_shingle():
    a, b, c = shingle_sets([b"a b", b"A  b", b"a b c d e"], 5)
    assert len(a) == len(c) == 1 and a[0] == b[0] != c[0]


def test_exhaustive_comparison_in_blocks(spark, monkeypatch):
    """With every member a component of its own, the blocks alone find all links."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(H, "BLOCK", 7)
    rows = [r for r in planted(6) if r[1] and r[1].strip()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    nodes = H.sketch(df).select(F.col("doc_id").alias("node"), "n_shingles", "registers", "bands")
    sets = df.select("doc_id", "text").mapInArrow(H._sets, "node long, hashes binary")
    open_ = nodes.select(F.explode("bands").alias("band"), "node", F.col("node").alias("comp"))
    open_ = open_.join(open_.groupBy("band").count().filter("count > 1").select("band"), "band").select("band", "node", "comp")
    links = H._across(open_, nodes.join(sets, "node"))
    labels = {r.node: r.comp for r in H.graph.components(links).collect()}
    want = {i: c for i, (n, c) in brute(rows).items()}
    assert {i: labels.get(i, i) for i, _ in rows} == want


def test_deduplicate_rows_that_share_or_lack_ids(spark):
    words = [f"w{k}" for k in range(60)]
    copy, near = " ".join(words), " ".join([*words[:-1], "other"])
    rows = [(None, "a b c d e f", 0), (3, "a b c d e f", 1), (3, "a b c d e f", 2), (9, "a b c d e f", 3)]
    rows += [(None, copy, 4), (None, copy, 5), (None, near, 6)]
    rows += [(3, "a text of its own under a shared id", 7), (7, None, 8), (7, None, 9), (None, "", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(3)
    made = H.deduplicate(df)
    got = sorted(r.n for r in made.collect())
    assert made.columns == df.columns and len(got) == 6
    assert len({1, 2} & set(got)) == 1 and len({4, 5, 6} & set(got)) == 1 and {7, 8, 9, 10} <= set(got)


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(100, 400)]
    star = [(1000, k) for k in range(1001, 3000)]
    edges = spark.createDataFrame([*chain, *star, (5, 5), (7, 6), (7, 6)], "a long, b long").repartition(3)
    got = {r.node: r.comp for r in H.graph.components(edges).collect()}
    want = {k: 100 for k in range(100, 401)} | {k: 1000 for k in range(1000, 3000)} | {6: 6, 7: 6}
    assert got == want
    assert H.graph.components(edges.limit(0)).count() == 0


def dense(n, seed=4):
    """One group whose members are mostly linked, none of them equal."""
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in range(120)]
    out = []
    for i in range(n):
        t = base.copy()
        for k in rng.choice(120, 2, replace=False):
            t[k] = f"v{rng.integers(10**9)}"
        out.append((i, " ".join(t)))
    return out


def test_links_of_a_large_group_grow_with_its_members(spark, monkeypatch):
    stored, keep = {}, H.materialize

    def count(df, name):
        out = keep(df, name)
        stored[name] = stored.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(H, "materialize", count)
    monkeypatch.setattr(H.graph, "materialize", count)
    made = []
    for n in (300, 900):
        stored.clear()
        rows = dense(n)
        found = H.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
        got = {r.doc_id: r.component_id for r in found.collect()}
        if n == 300:
            assert got == {i: c for i, (_, c) in brute(rows).items()}
        made.append((stored["edges"], stored["labels"]))
    assert made[1][0] <= 4 * made[0][0] and made[1][0] <= 12 * 900


def test_long_texts_are_dealt_by_their_shingles(spark, monkeypatch):
    """A third of all rows in one near group, long texts among them, blocks of a few hundred shingles."""
    monkeypatch.setattr(H, "BLOCK_SHINGLES", 600)
    monkeypatch.setattr(H, "LIGHT", 0)
    rng = np.random.default_rng(12)
    vocab = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(4000)]
    base, rows = list(rng.choice(vocab, 400)), []
    for i in range(40):
        t = base[: 400 - 3 * i] if i % 2 else base[3 * i :]
        rows.append((i, " ".join(t)))
    for i in range(40, 120):
        n = int(rng.integers(5, 60)) if i % 10 else 3000
        rows.append((i, " ".join(rng.choice(vocab, n))))
    rows += [(120 + k, rows[50][1] + " tail" * (k % 3)) for k in range(4)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in H.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute(rows)


def test_spread_join(spark, monkeypatch):
    from weftlake.llm import common

    monkeypatch.setattr(common, "HOT", 10)
    many = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)], "k int, v int")
    one = spark.createDataFrame([(i, f"x{i}") for i in range(0, 300, 2)] + [(1, "hot")], "k int, t string")
    want = sorted((r.k, r.v, r.t) for r in many.join(one, "k").collect())
    assert sorted((r.k, r.v, r.t) for r in common.spread_join(many, one, "k", "v").collect()) == want
    monkeypatch.setattr(common, "HOT", 1000)
    assert sorted((r.k, r.v, r.t) for r in common.spread_join(many, one, "k", "v").collect()) == want
