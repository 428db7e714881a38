"""Near-duplicate detection with HyperMinHash sketches.

A document's 5-word shingles are hashed to 64 bits.  Seven bits name one of 128
buckets; the smallest of the remaining bits in a bucket is kept as the count of
its leading zeros (6 bits) and the 10 bits that follow the leading one: 16 bits
a register.  A bucket that no shingle hits borrows, for banding only, from the
first non-empty bucket in a fixed random order of its own, so that short texts
have full sketches whose registers still agree with the texts' similarity.

1. Documents with equal shingle sets form a class (hash aggregation; a third of
   all rows may be one class) and only its smallest doc_id goes on.
2. 32 bands of 4 registers name buckets of classes.  At similarity 0.75 a pair
   misses all 32 bands with probability 5e-6.
3. Links are looked for in turns, each only in buckets that still hold more than
   one component, and each turn's links are contracted before the next, so what
   a large group sends on shrinks with every turn.  First every node meets one
   of its buckets' centres, then all of them (and the centres leave: they have
   met every member).  In what is open after that every member outside a
   bucket's largest component is compared with all members, in blocks, with no
   cap; a block sends on a forest of its links.
4. Pairs pass if the collision-corrected register estimate is within 5 standard
   deviations of the threshold; they are then confirmed on the full sets.

Defined results: null or wordless text has no shingles, is linked with nothing
and is kept; rows that share a doc_id are one document; a null doc_id never
becomes a component's id, and a row with a null doc_id is kept unless its class
has a row with one; extra columns are not read; an empty table gives an empty
result.  ``deduplicate`` takes every row for a document, so repeated rows and
rows with a null doc_id leave one row of each component as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from . import graph
from .common import materialize, salted_join, spread_join
from .textnum import mix64, shingle_sets

SHINGLE = 5
PERCENT = 75
BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
BANDS, ROWS = 32, 4
#: Turns in which a node meets one of its centres, before the turn in which it meets them all.
LIGHT = 1
#: Bands of the turns of the last, exhaustive comparison.
LAST = ((0, 4), (4, BANDS))
#: Members of one side of a task in the last, exhaustive comparison, and shingles (of eight bytes) that they have together on average.
BLOCK, BLOCK_SHINGLES = 256, 2_000_000

EMPTY = np.uint16(0xFFFF)
_rng = np.random.default_rng(7_407)
#: For each bucket, itself and then the others in random order.
_ORDER = np.stack([np.concatenate([[j], _rng.permutation(np.delete(np.arange(BUCKETS), j))]) for j in range(BUCKETS)])
_FACTORS = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_EDGES = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)


def registers(hashes: np.ndarray) -> np.ndarray:
    """128 registers (uint16; EMPTY where no hash falls) of sorted distinct hashes."""
    out = np.full(BUCKETS, EMPTY, np.uint16)
    at = np.searchsorted(hashes, _EDGES)
    full = np.append(at[1:], len(hashes)) > at
    least = hashes[at[full]] << np.uint64(BUCKET_BITS)
    _, exponent = np.frexp((least >> np.uint64(11)).astype(np.float64))
    zeros = np.uint64(53) - exponent.astype(np.uint64)
    mantissa = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA_BITS)
    out[full] = (zeros << np.uint64(MANTISSA_BITS) | mantissa).astype(np.uint16)
    return out


def bands(regs: np.ndarray) -> np.ndarray:
    """32 band keys (int64) of registers, empty buckets borrowing from others."""
    source = _ORDER[np.arange(BUCKETS), (regs != EMPTY)[_ORDER].argmax(1)]
    values = (source.astype(np.uint64) << np.uint64(16)) | regs[source].astype(np.uint64)
    keys = (mix64(values.reshape(BANDS, ROWS)) * _FACTORS).sum(1, dtype=np.uint64)
    return mix64(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def expected_collisions(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """The chance that a bucket's two registers agree when the sets share nothing.

    The minima of n/BUCKETS uniform values have density s*exp(-s*x); a register
    cell between 2**-(l+1) and 2**-l is 2**-(l+1) * 2**-MANTISSA_BITS wide.
    """
    a, b = n1[:, None] / BUCKETS, n2[:, None] / BUCKETS
    high = np.exp2(-np.arange(54.0))[None, :]
    low = high / 2
    mass = (np.exp(-(a + b) * low) - np.exp(-(a + b) * high)) * low
    return np.minimum(0.5, (a * b / (a + b) * 2.0**-MANTISSA_BITS * mass.sum(1, keepdims=True))[:, 0])


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of register rows, corrected for chance, and buckets used."""
    used = ((ra != EMPTY) | (rb != EMPTY)).sum(1)
    same = ((ra == rb) & (ra != EMPTY)).sum(1)
    chance = expected_collisions(na.astype(float), nb.astype(float))
    return np.clip((same / np.maximum(used, 1) - chance) / (1 - chance), 0, 1), used


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            texts = [(t or "").encode() for t in part.column(1).to_pylist()]
            n, digest, regs, keys = [], [], [], []
            for s in shingle_sets(texts, SHINGLE):
                n.append(len(s))
                if len(s):
                    r = registers(s)
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest())
                    regs.append(r.tobytes())
                    keys.append(bands(r))
                else:
                    digest.append(None)
                    regs.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(regs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_id", "registers", "bands"],
            )


def sketch(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id (of the shingle set), registers, bands."""
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sketches, "doc_id long, n_shingles long, set_id string, registers binary, bands array<long>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = [(t or "").encode() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(texts, SHINGLE)], pa.binary())], names=["node", "hashes"])


@F.pandas_udf(BooleanType())
def _likely(ra: pd.Series, rb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
    if not len(ra):
        return pd.Series([], dtype=bool)
    a, b = (np.frombuffer(b"".join(x), np.uint16).reshape(len(x), BUCKETS) for x in (ra, rb))
    j, used = estimate(a, b, na.to_numpy(), nb.to_numpy())
    t = PERCENT / 100
    return pd.Series(j >= t - 5 * np.sqrt(t * (1 - t) / np.maximum(used, 1)))


@F.pandas_udf(BooleanType())
def _linked(sa: pd.Series, sb: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(sa, sb):
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if len(a) > len(b):
            a, b = b, a
        at = np.searchsorted(b, a)
        same = int((b[np.minimum(at, len(b) - 1)] == a).sum())
        out.append(100 * same >= PERCENT * (len(a) + len(b) - same))
    return pd.Series(out, dtype=bool)


def _confirm(pairs: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of nodes and centres (a, b, comp_a, comp_b) -> links between components (a, b).

    A node has a centre a band at most; a centre may have most nodes, and its row is sent to as many tasks as it needs.
    """
    side = lambda x, t: t.select(*[F.col(c).alias(x if c == "node" else f"{c}_{x}") for c in t.columns])
    pairs = materialize(pairs, "pairs")
    near = spread_join(pairs, side("b", nodes), "b", "a").join(side("a", nodes), "a").filter(_likely("registers_a", "registers_b", "n_shingles_a", "n_shingles_b"))
    likely = materialize(near.select("a", "b", "comp_a", "comp_b"), "likely")
    full = spread_join(likely, side("b", sets), "b", "a").join(side("a", sets), "a").filter(_linked("hashes_a", "hashes_b"))
    return materialize(full.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).distinct(), "links")


def _hashed(turn: int):
    """A member's rank in its bucket: by a hash of node and band, so that a group's buckets have different centres."""
    return F.xxhash64("node", "band", F.lit(turn))


def _open(members: DataFrame, turn: int) -> DataFrame:
    """Members of buckets with more than one component: band, k, node, comp, centre, comp_c."""
    ends = members.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct(_hashed(turn).alias("h"), "node", "comp")).alias("c"))
    ends = ends.filter("lo <> hi").select("band", F.col("c.node").alias("centre"), F.col("c.comp").alias("comp_c"))
    return materialize(salted_join(members, ends, "band", salt="node"), "open")


def _met(rows: DataFrame) -> DataFrame:
    """Pairs of members and centres that are not in one component yet."""
    return rows.filter("comp <> comp_c").select(F.col("node").alias("a"), F.col("centre").alias("b"), F.col("comp").alias("comp_a"), F.col("comp_c").alias("comp_b")).distinct()


def _contracted(members: DataFrame, labels: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and labels with the links' components merged."""
    if not links.limit(1).count():
        return members, labels
    merged = graph.components(links)
    renamed = merged.select(F.col("node").alias("comp"), F.col("comp").alias("_to"))

    def renew(rows: DataFrame, name: str) -> DataFrame:
        out = salted_join(rows, renamed, "comp", "left", salt="node").withColumn("comp", F.coalesce("_to", "comp"))
        return materialize(out.select(*rows.columns), name)

    return renew(members, "members"), renew(labels, "labels")


_BLOCK_SCHEMA = "a long, b long"


def _block_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of a block's minor members with members of other components: a forest of components.

    A pair that shares an earlier band meets there.  All of a minor's pairs are
    counted in one pass over the others' shingles.
    """
    band = rows["band"].iloc[0]
    keys = np.stack([np.asarray(x, np.int64) for x in rows["bands"]])
    regs = np.stack([np.frombuffer(x, np.uint16) for x in rows["registers"]])
    sizes = rows["n_shingles"].to_numpy()
    node, comp, minor = rows["node"].to_numpy(), rows["comp"].to_numpy(), rows["minor"].to_numpy()
    values, ids = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in rows["hashes"]]), return_inverse=True)
    ends = np.cumsum(sizes)
    own = [ids[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
    earlier = np.cumsum(keys == band, axis=1) == 0  # bands before this one
    present, t, out, above = np.zeros(len(values), bool), PERCENT / 100, [], {}

    def root(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    others = np.flatnonzero(~minor)
    for i in np.flatnonzero(minor).tolist():
        j = others[comp[others] != comp[i]]
        j = j[~((keys[j] == keys[i]) & earlier[i]).any(1)]
        if len(j):
            est, used = estimate(regs[j], np.broadcast_to(regs[i], (len(j), BUCKETS)), sizes[j], np.full(len(j), sizes[i]))
            j = j[est >= t - 5 * np.sqrt(t * (1 - t) / np.maximum(used, 1))]
        if not len(j):
            continue
        present[own[i]] = True
        n = sizes[j]
        same = np.add.reduceat(present[np.concatenate([own[k] for k in j.tolist()])].astype(np.int64), np.cumsum(n) - n)
        present[own[i]] = False
        j = j[100 * same >= PERCENT * (n + sizes[i] - same)]
        for x in np.unique(comp[j]).tolist():
            one, two = root(comp[i]), root(x)
            if one != two:
                above[max(one, two)] = min(one, two)
                out.append((int(comp[i]), x))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def _across(open_: DataFrame, payload: DataFrame) -> DataFrame:
    """Links between components within open buckets (band, node, comp).

    Members of a bucket's largest component need no comparison with each other;
    the others, its minor members, meet all members.  Both sides are dealt to
    blocks by their number and by what their shingles take, and a task holds one
    block of each, so a bucket of any size, and of texts of any length, is
    compared in bounded tasks and only links leave them.  (A block holds as much
    as one text does where that is more.)
    """
    sized = open_.join(payload.select("node", "n_shingles"), "node")
    parts = sized.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    parts = parts.groupBy("band").agg(F.max(F.struct("n", "comp", "w")).alias("m"), F.sum("n").alias("all"), F.sum("w").alias("w"))
    # as many as members ask for, or as many as their shingles do, but no more than there are members
    blocks = lambda n, w: F.least(n, F.greatest(F.ceil(n / F.lit(float(BLOCK))), F.ceil(w / F.lit(float(BLOCK_SHINGLES))))).cast("int")
    minor = blocks(F.col("all") - F.col("m.n"), F.col("w") - F.col("m.w"))
    parts = parts.select("band", F.col("m.comp").alias("main"), blocks(F.col("all"), F.col("w")).alias("all_blocks"), minor.alias("minor_blocks"))
    rows = materialize(salted_join(open_, parts, "band", salt="node").join(payload, "node"), "payload")
    deal = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    minor = rows.filter("comp <> main").withColumn("i", deal("minor_blocks", 1)).withColumn("j", spread("all_blocks")).withColumn("minor", F.lit(True))
    every = rows.withColumn("j", deal("all_blocks", 2)).withColumn("i", spread("minor_blocks")).withColumn("minor", F.lit(False))
    both = minor.unionByName(every).select("band", "i", "j", "node", "comp", "minor", "n_shingles", "registers", "bands", "hashes")
    return materialize(both.groupBy("band", "i", "j").applyInPandas(_block_links, _BLOCK_SCHEMA).distinct(), "across")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of documents(doc_id, text)."""
    sketches = materialize(sketch(documents), "sketches")
    classes = sketches.filter("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("node"))
    classes = materialize(classes, "classes")
    # one row of each class: its smallest doc_id's (rows that share a doc_id may stand for two classes)
    nodes = sketches.join(classes.withColumnRenamed("node", "doc_id"), ["set_id", "doc_id"], "left_semi").dropDuplicates(["set_id"])
    nodes = materialize(nodes.select(F.col("doc_id").alias("node"), "n_shingles", "registers", "bands"), "nodes")
    members = nodes.select(F.posexplode("bands").alias("k", "band"), "node", F.col("node").alias("comp"))
    rows = _open(members, 0)
    labels = materialize(rows.select("node", "comp").distinct(), "labels")
    texts = documents.select(F.col("doc_id").cast("long"), "text").join(labels.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    sets = materialize(texts.mapInArrow(_sets, "node long, hashes binary"), "sets")
    nodes = materialize(nodes.join(labels.select("node"), "node", "left_semi"), "shared")
    slim = nodes.select("node", "n_shingles", "registers")
    for turn in range(LIGHT + 1):
        if turn:
            rows = _open(members, turn)
        if turn < LIGHT:  # the centre with the smallest hash, so that few steps lead to one another; it stays a member
            one = rows.groupBy("node").agg(F.min(F.struct(F.xxhash64("centre", F.lit(turn)).alias("h"), "comp", "centre", "comp_c")).alias("m"))
            met, members = one.select("node", "m.comp", "m.centre", "m.comp_c"), rows.select("k", "band", "node", "comp")
        else:
            met, members = rows, rows.filter("node <> centre").select("k", "band", "node", "comp")
        members, labels = _contracted(members, labels, _confirm(_met(met), slim, sets))
    payload = nodes.join(sets, "node")
    for low, high in LAST:
        rows = _open(members.filter(F.col("k").between(low, high - 1)), 0)
        members, labels = _contracted(members, labels, _across(rows.select("band", "node", "comp"), payload))
    named = sketches.select("doc_id", "n_shingles", "set_id").join(classes, "set_id", "left").join(labels, "node", "left")
    component = F.coalesce("comp", "node", "doc_id")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicate(documents: DataFrame) -> DataFrame:
    """One row of each component, whole: of the smallest doc_id (null last), the first such row.

    Every row is a document here, by a stored key of its own, whatever doc_id
    it has or shares; rows without shingles are all kept.
    """
    keyed = materialize(documents.withColumn("_key", F.monotonically_increasing_id()), "keyed")
    found = near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), "component_id")
    named = materialize(found.join(keyed.select("_key", F.col("doc_id").cast("long")), "_key"), "named")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")).alias("_first"))
    gone = materialize(named.select("_key").join(first.select("_first._key"), "_key", "left_anti"), "gone")
    return keyed.join(gone, "_key", "left_anti").select(*documents.columns)
