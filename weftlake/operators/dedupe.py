"""Exact and near duplicates by 64-bit fingerprints, and greedy leaders among them.

Equal fingerprints form a class with the smallest id as its representative, so
a large group of copies is one row; pairs are between representatives.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import md5
from ..functions import text as T
from ..session import dealt

#: Blocks of a fingerprint; every pair at this distance or less agrees in half of them.
BLOCKS, MAX_DISTANCE = 6, 3
#: Words of a shingle.
SIZE = 3


def exact_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """content_hash, smallest id, copies: of texts that occur more than once."""
    return df.groupBy(T.content_hash(F.encode(F.col(text), "UTF-8")).alias("content_hash")).agg(F.min(key).alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def duplicate_of(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each id with the smallest other id of the same content, or null."""
    h = df.select(key, T.content_hash(F.encode(F.col(text), "UTF-8")).alias("h"))
    ends = h.groupBy("h").agg(F.min(key).alias("lo"))
    return h.join(ends, "h").select(key, F.when(F.col("lo") != F.col(key), F.col("lo")).alias("duplicate_of"))


_BITS = np.left_shift(np.int64(1), np.arange(31, -1, -1, dtype=np.int64))


#: Characters of the texts that are hashed together.
TOGETHER = 1 << 22


def _votes(texts: list[str]) -> np.ndarray:
    """hi, lo of texts of words between single spaces: the signs of the sums of their shingles' MD5 bits, the first 64.

    A shingle is a stretch of its text, so nothing is joined: only places are counted.
    """
    raw, n = " ".join(texts).encode(), np.array([t.count(" ") + 1 for t in texts])
    space = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    begin, end, ends = np.append(0, space + 1), np.append(space, len(raw)), np.cumsum(n)
    runs = np.maximum(n - SIZE + 1, 1)
    upto = np.cumsum(runs)
    word = np.arange(upto[-1]) + np.repeat(ends - n - (upto - runs), runs)
    last = np.minimum(word + SIZE, np.repeat(ends, runs)) - 1
    head = md5.first_eight(raw, begin[word], end[last] - begin[word])
    out = np.empty((len(texts), 2), np.int64)
    for i, (k, m) in enumerate(zip(upto.tolist(), runs.tolist())):
        ones = sum(np.unpackbits(head[j : min(j + md5.LANES, k)], axis=1).sum(0, dtype=np.int64) for j in range(k - m, k, md5.LANES))
        out[i] = ((2 * ones > m).reshape(2, 32) * _BITS).sum(1)
    return out


def _md5_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of rows (key, words between single spaces), some texts at a time; rows without words are left out."""
    for batch in batches:
        rows, texts, held = [], [], 0
        for i, t in enumerate(batch.column(1)):
            if t := t.as_py():
                rows.append(i)
                texts.append(t)
                held += len(t)
            if texts and (held >= TOGETHER or i + 1 == batch.num_rows):
                out = _votes(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(out[:, 0]), pa.array(out[:, 1])], names=[batch.schema.names[0], "hi", "lo"])
                rows, texts, held = [], [], 0


def simhash_md5(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, hi, lo: the fingerprint's halves, by signed votes over shingles' MD5 bits; votes stay in the row.

    Texts are dealt over the cores: a file of many is one split where its rows are one group.
    """
    worded = dealt(df.select(key, text), key).select(key, T.spaced_words(F.col(text)).alias("w"))
    return worded.mapInArrow(_md5_votes, f"`{key}` {dict(df.dtypes)[key]}, hi long, lo long")


def simhash_blake2b(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, simhash (signed 64 bits)."""
    return dealt(df.select(key, text), key).select(key, T.simhash_blake2b(T.words(F.col(text))).alias("simhash"))


def fingerprint_classes(prints: DataFrame, key: str = "doc_id") -> DataFrame:
    """hi, lo, rep (smallest id), copies; texts without words take no part."""
    return prints.filter("hi <> 0 or lo <> 0").groupBy("hi", "lo").agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("copies"))


#: Classes of one key that meet all others of it in one task.
MEETING = 1000


def meet(one: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by shuffles alone.

    Fingerprints are narrow and a class becomes 20 rows, which Spark's estimates
    leave out: it takes millions of rows for a small table, and a broadcast would
    bring them all to the driver.
    """
    return one.join(other.hint("merge"), on, how)


def distance_of(hi: str, lo: str, hi_b: str, lo_b: str) -> Column:
    """Bits in which two fingerprints differ."""
    return (F.bit_count(F.col(hi).bitwiseXOR(F.col(hi_b))) + F.bit_count(F.col(lo).bitwiseXOR(F.col(lo_b)))).cast("int")


def band_keys(classes: DataFrame) -> DataFrame:
    """table, key, rep, hi, lo: each class once in each of 20 tables.

    64 bits are cut into BLOCKS blocks; of two prints at most MAX_DISTANCE bits
    apart, at least BLOCKS - MAX_DISTANCE blocks agree, so the pair meets in a
    table keyed on that many of them: some 32 bits.
    """
    cuts = [0, 11, 22, 32, 43, 54, 64]  # of hi, then lo
    block = lambda k: F.shiftright(F.col("hi" if k < 3 else "lo"), (32 if k < 3 else 64) - cuts[k + 1]).bitwiseAND((1 << (cuts[k + 1] - cuts[k])) - 1)
    parts = classes.select("rep", "hi", "lo", F.array(*[block(k).cast("long") for k in range(BLOCKS)]).alias("p"))
    tables = list(combinations(range(BLOCKS), BLOCKS - MAX_DISTANCE))
    keys = F.array(*[F.struct(F.lit(t).alias("table"), F.struct(*[F.get("p", F.lit(k)).alias(f"k{j}") for j, k in enumerate(of)]).alias("key")) for t, of in enumerate(tables)])
    return parts.select("rep", "hi", "lo", F.explode(keys).alias("_k")).select("_k.table", "_k.key", "rep", "hi", "lo")


def near_pairs(classes: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """a, b, distance of classes' representatives (a < b) within ``distance``.

    Keys of one class alone are dropped before the join; the classes of a
    frequent key are dealt to blocks that meet pair by pair, each in a task.
    """
    if distance > MAX_DISTANCE:
        raise ValueError(f"six blocks find all pairs up to distance {MAX_DISTANCE} only")
    keyed = band_keys(classes)
    shared = keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")  # most keys are one class's alone
    keyed = meet(keyed, shared, ["table", "key"]).withColumn("_n", F.ceil(F.col("n") / MEETING).cast("int")).withColumn("_at", F.pmod(F.xxhash64("rep"), F.col("_n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    one = keyed.select("table", "key", "rep", "hi", "lo", F.col("_at").alias("_i"), every.alias("_j"))
    other = keyed.select("table", "key", *[F.col(c).alias(f"{c}_b") for c in ("rep", "hi", "lo")], every.alias("_i"), F.col("_at").alias("_j"))
    apart = distance_of("hi", "lo", "hi_b", "lo_b")
    met = meet(one, other, ["table", "key", "_i", "_j"]).filter((F.col("rep") < F.col("rep_b")) & (apart <= distance))
    return met.select(F.col("rep").alias("a"), F.col("rep_b").alias("b"), apart.alias("distance")).distinct()


#: Pairs of a component that one task resolves.
RESOLVED = 100_000


def components(pairs: DataFrame, store) -> DataFrame:
    """node, comp of ``pairs(a, b)``: the smallest node reachable.

    Labels take the smallest of their neighbours' and then their label's label,
    so chains shrink by halves; the rounds end when none has changed.
    """
    both = store(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")))
    while True:
        near = meet(both, labels.select(F.col("node").alias("b"), F.col("comp").alias("_c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("_c").alias("_near"))
        hooked = meet(labels, near, "node").select("node", F.col("comp").alias("_old"), F.least("comp", "_near").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("_up"))
        fresh = store(meet(hooked, up, "comp", "left").select("node", "_old", F.least("comp", F.coalesce("_up", "comp")).alias("comp")))
        labels = fresh.select("node", "comp")
        if not fresh.filter("comp <> _old").limit(1).count():
            return labels


def _resolved(rows: pa.Table) -> pa.Table:
    """The greedy choice inside one component, in order of ids."""
    before: dict[int, list[tuple[int, int]]] = {}
    ids = set()
    for a, b, d in zip(*(rows.column(c).to_pylist() for c in ("a", "b", "distance"))):
        before.setdefault(b, []).append((d, a))
        ids |= {a, b}
    leader: dict[int, int] = {}
    for x in sorted(ids):
        leader[x] = min(((d, a) for d, a in before.get(x, ()) if leader[a] == a), default=(0, x))[1]
    return pa.table({"rep": pa.array(list(leader), pa.int64()), "leader": pa.array(list(leader.values()), pa.int64())})


def leaders(classes: DataFrame, pairs: DataFrame, store) -> DataFrame:
    """rep, leader: greedy choice in order of ids: the nearest (then earliest) leader among earlier neighbours, or oneself.

    Choices depend on a component's own pairs alone.  A component of at most
    RESOLVED pairs is resolved in order by one task; larger ones by rounds.
    ``store`` keeps a frame between rounds.
    """
    pairs = store(pairs)
    comps = components(pairs, store)
    keyed = store(meet(pairs, comps.select(F.col("node").alias("a"), "comp"), "a"))
    sizes = store(keyed.groupBy("comp").agg((F.count(F.lit(1)) > RESOLVED).alias("large")))
    keyed = store(meet(keyed, sizes, "comp"))
    done = keyed.filter("not large").groupBy("comp").applyInArrow(_resolved, "rep long, leader long")
    if sizes.filter("large").limit(1).count():
        some = keyed.filter("large").select("a", "b", "distance")
        nodes = some.select(F.col("a").alias("rep")).union(some.select("b")).distinct()
        done = done.unionByName(_by_rounds(nodes, some, store))
    alone = meet(classes.select("rep"), comps.select(F.col("node").alias("rep")), "rep", "left_anti").select("rep", F.col("rep").alias("leader"))
    return alone.unionByName(done)


def _by_rounds(classes: DataFrame, pairs: DataFrame, store) -> DataFrame:
    """Without a sequential pass: a class leads once all earlier neighbours are known not to; the first undecided one is always decided."""
    state = store(classes.select("rep", F.lit(None).cast("long").alias("leader")))
    pairs = store(pairs)
    while True:
        before = meet(pairs, state.select(F.col("rep").alias("a"), F.col("leader").alias("lead_a")), "a")
        seen = before.groupBy(F.col("b").alias("rep")).agg(
            F.min(F.when(F.col("lead_a") == F.col("a"), F.struct("distance", F.col("a").alias("id")))).alias("to"), F.count_if(F.col("lead_a").isNull()).alias("open")
        )
        new = F.coalesce("leader", F.when(F.coalesce("open", F.lit(0)) == 0, F.coalesce(F.col("to.id"), F.col("rep"))))
        state = store(meet(state, seen, "rep", "left").select("rep", new.alias("leader")))
        if not state.filter("leader is null").limit(1).count():
            return state
