"""Prefix trie: rebuilt conversations and rolled-up totals against plain Python and SQL."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

from weftlake.llm import prefixtrie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth int"


def brute(rows):
    by = collections.defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            tie = hashlib.md5(f"{r or ''}\0{x or ''}".encode()).hexdigest()
            by[c].append(((t is not None, t or 0, tie), r or "", x or ""))
    by = {c: [(r, x) for _, r, x in sorted(v)] for c, v in by.items()}
    whole = {}
    for c, v in by.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = by.get(int(c - np.fmod(c, 20)), [])[:h] + v[h:]
    members = collections.defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children, leaves, saved = collections.Counter(k[:-1] for k in members if k), collections.Counter(), collections.Counter()
    for k, m in members.items():
        own = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own
            leaves[k[:d]] += k not in children
    done = lambda k: hashlib.sha256(",".join(map(str, sorted(c for c in members[k] if len(whole[c]) == len(k)))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], done(k)) for k, m in members.items())


def run(spark, rows):
    found = P.prefix_nodes(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3)).collect()
    return sorted(tuple(r) for r in found)


def made(seed, convs, words=("a", "b b", "c  c\tc")):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(convs):
        rows += [(c, t, ("user", "assistant")[t % 2], words[rng.integers(len(words))]) for t in range(rng.integers(1, 7))]
    return rows


@pytest.fixture
def tight(monkeypatch):
    for name, value in (("LOCAL", 12), ("STRETCH", 3), ("CHUNK", 4)):
        monkeypatch.setattr(P, name, value)


def test_rounds_and_local_parts(spark, tight):
    rows = made(1, 90) + [(300, t, "user", f"w {t}") for t in range(40)] + [(c, t, "user", f"t{t}") for c in range(400, 440) for t in range(3)]
    assert run(spark, rows) == brute(rows)


def test_local_parts_alone():
    rng = np.random.default_rng(2)
    n = 400
    up = np.array([-1] + [int(rng.integers(max(0, i - 3), i)) for i in range(1, n)])
    depth = np.zeros(n, np.int64)
    for i in range(1, n):
        depth[i] = depth[up[i]] + 1
    own = rng.integers(0, 9, (n, 2))
    weight = rng.integers(1, 5, n)
    below, total = weight.copy(), own.copy()
    for i in range(n - 1, 0, -1):
        below[up[i]] += below[i]
        total[up[i]] += total[i]
    mixed = rng.permutation(n)
    twice = np.concatenate([mixed, mixed])
    got = P._local_totals(np.repeat([0, 1], n), twice, depth[twice], up[twice], below[twice], own[twice])
    assert (got == total[twice]).all()


def test_odd_rows_and_sql(spark, tight):
    rows = made(3, 30) + [(None, 1, "user", "x"), (None, None, None, None)]
    rows += [(50, None, None, "b"), (50, None, "user", None), (50, 2, "user", ""), (50, 2, "user", ""), (50, 2, None, None)]  # null turns first; equal turns
    rows += [(41, 0, "user", "only")] + [(c, 0, "user", "same") for c in (60, 61, 62, 63, 64, 65, 66, 67, 68, 69)]
    rows += [(-21, 0, "user", "a"), (-21, 1, "user", "z"), (-20, 0, "user", "q"), (80, 0, "user", "long word " * 30_000), (81, 0, "usera", "b"), (82, 0, "user", "ab")]
    got = run(spark, rows)
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert got == sorted(con.execute(P.ORACLE).fetchall())


def test_one_conversation_holds_most(spark, tight):
    rows = [(7, t, "user", f"{t % 5} x") for t in range(150)] + made(4, 12)
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    got = P.prefix_nodes(spark.createDataFrame([], SCHEMA))
    assert got.collect() == [] and got.columns == [c.split()[0] for c in P.RESULT.split(", ")]
