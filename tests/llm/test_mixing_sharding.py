"""Mixing and sharding against plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from weftlake.llm import mixing, sharding


def plain_mix(rows):
    """doc_id -> (size, source_size, target, copies); targets by the iteration itself."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    budget, target, active = 1.5 * sum(total.values()), {}, set(sources)
    while active:
        level = (budget - sum(target.values())) / sum(weight[s] for s in active)
        over = {s for s in active if level * weight[s] >= 2 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in active}
            break
        target |= {s: 2.0 * total[s] for s in over}
        active -= over
    out = {}
    for s in sources:
        whole = int(target[s] // total[s] + 1e-12) if total[s] else 0
        rest, run = target[s] - whole * total[s], 0
        order = sorted((hashlib.md5(f"{mixing.SEED}:{'null' if i is None else i}".encode()).hexdigest(), i or 0, i) for i, _, x in rows if x == s)
        for _, _, i in order:
            run += size[i]
            out[i] = (size[i], total[s], target[s], whole + (2 * run - size[i] <= 2 * rest + 1e-6) if size[i] else 0)
    return out


ROWS = [(i, " ".join(["w"] * (i * 7 % 53)) + "\n x", f"src{i % 5 if i % 3 else 9}") for i in range(200)] + [(200, None, "src1"), (201, "", None), (202, "a b", None), (None, "c d e", "only"), (203, "", "void")]


def test_mix(spark):
    df = spark.createDataFrame([(*r, -1) for r in ROWS], "doc_id long, text string, source string, size int").repartition(3)
    want = plain_mix(ROWS)
    for rows in (mixing.mix_digest(df).collect(), mixing.mix(df).collect()):
        assert len(rows) == len(ROWS)
        for r in rows:
            size, total, target, copies = want[r.doc_id]
            assert (r.size, r.source_size, r.taken) == (size, total, size * copies) and abs(r.target - target) < 1e-6
    made = mixing.mixture(df)
    assert made.columns == df.columns and Counter(r.doc_id for r in made.collect()) == Counter({i: c for i, (*_, c) in want.items() if c})
    assert {r.size for r in made.collect()} == {-1}
    assert mixing.mix_digest(df.limit(0)).count() == mixing.mixture(df.limit(0)).count() == 0


def test_mix_is_native(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    for made in (mixing.mix_digest(df), sharding.shard_documents(df)):
        plan = made._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def hashed(key, shard):
    seed = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
    h = xxhash.xxh64_intdigest(shard.to_bytes(8, "little"), seed)
    return h - (1 << 64) if h >> 63 else h


def test_shards(spark):
    rows = [(i, t) for i, t, _ in ROWS] + [(5, "again"), (5, "again"), (-3, "né")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int").repartition(3)
    got = sharding.shard_documents(df).collect()
    best = lambda i, n: max(range(n), key=lambda s: (hashed(i, s), s))
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), best(i, 40), best(i, 41)) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    for s in range(40):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 40) and r.law == "key" for r in got)
    assert sharding.shard_documents(df.limit(0)).count() == 0


def test_weights_set_shares(spark):
    df = sharding.shard_records(spark.range(40_000), "id", 3, [1.0, 2.0, 5.0])
    share = {r.shard: r["count"] / 40_000 for r in df.groupBy("shard").count().collect()}
    assert all(abs(share[k] - w / 8) < 0.01 for k, w in enumerate((1, 2, 5)))
    grown = sharding.shard_records(df, "id", 4, [1.0, 2.0, 5.0, 2.0], "more")
    moved = grown.filter(F.col("more") != F.col("shard"))
    assert moved.filter("more <> 3").count() == 0 and abs(moved.count() / 40_000 - 0.2) < 0.01


def test_ties_at_the_cut_are_counted(spark):
    import duckdb

    rows = [(7, "a b" + " \n" * (k % 2), "s") for k in range(1000)] + [(i, "c", None) for i in [5] * 90 + [None] * 90] + [(k, "x y z", "t") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    want = Counter((i, n, whole, round(t, 6), taken) for i, n, whole, t, taken in con.execute(mixing.ORACLE).fetchall())
    got = mixing.mix_digest(df).collect()
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == want
    taken = Counter(len(r.text.split()) for r in mixing.mixture(df).collect())  # a size for each source
    assert {n: n * k for n, k in taken.items()} == {n: sum(r.taken for r in got if r.size == n) for n in taken}
    assert all(abs(n * taken[n] - r.target) <= n / 2 + 1e-6 for r in got for n in [r.size])
