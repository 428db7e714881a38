"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

A vector is scaled to length one and rounded to ``q``, 127 steps to each side
of zero, with its own step ``s``; the length ``e`` of what rounding took from
it is kept beside it.  With ``r`` the length of ``s * q``, the cosine of two
vectors differs from ``s1 * s2 * (q1 . q2)`` by at most ``r1 * e2 + e1``, so

* a pair whose product plus that bound stays below the threshold is no link,
* a pair whose product less that bound reaches it is one,
* only the pairs between are computed in double precision.

Products of a tile are one matrix product of whole numbers.  They are carried
in single precision, which holds whole numbers below 2**24 exactly, for at most
1,024 dimensions at a time; the bounds hold for every vector, so the result is
that of comparing all pairs.

Equal vectors form one class (hash aggregation; a third of all rows may be one
vector).  Classes are dealt to blocks of ``BLOCK_BYTES``; a task holds a pair of
blocks and gives back, for each vector with links, the number of vectors it is
linked with there, and its block pair's components as a star.  Links themselves
never leave a task, so a group of any size sends on one row for a vector and
block pair.  Components are then joined over the stars.  The work is all pairs
of classes, as the method asks: rows x rows / 2 products of bytes, in tasks of
one size.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are kept; vectors of different lengths are not
linked; every row counts as a vector, rows with one id or none too; a component
is named by its smallest id, null only where all ids are null; equal vectors
are linked with each other; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .addquant import scaled, usable
from .common import materialize, meet, salted_join

THRESHOLD = 0.9
#: Bytes of a block's vectors, eight a component: 4,096 vectors of 64 dimensions.
BLOCK_BYTES = 2 << 20
#: Rows of one block that meet the whole other block at once.
TILE_ROWS = 256
#: More than the rounding errors of the bounds themselves, which are some 1e-13.
SLACK = 1e-9
STEPS = 127


class Block:
    """Vectors of one block with their int8 form and its errors."""

    def __init__(self, ids: np.ndarray, members: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.members = ids, members
        self.x = scaled(x)
        self.square = np.einsum("ij,ij->i", self.x, self.x)
        unit = self.x / np.sqrt(self.square)[:, None]
        self.step = np.abs(unit).max(1) / STEPS
        self.q = np.rint(unit / self.step[:, None]).astype(np.int8)
        kept = self.q * self.step[:, None]
        self.length = np.sqrt(np.einsum("ij,ij->i", kept, kept))
        rest = unit - kept
        self.error = np.sqrt(np.einsum("ij,ij->i", rest, rest))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number products of int8 rows, exact."""
    total = None
    for at in range(0, a.shape[1], 1024):
        part = a[:, at : at + 1024].astype(np.float32) @ b[:, at : at + 1024].astype(np.float32).T
        total = part if total is None else total.astype(np.float64) + part
    return total


def tile_links(a: Block, b: Block, same: bool, threshold: float = THRESHOLD, computed: list[int] | None = None):
    """Linked positions (i, j) of two blocks, a stretch of rows at a time; i < j where both are one block.

    ``computed`` gathers how many pairs were computed in double precision.
    """
    worst = b.error.max()
    wide = b.q.astype(np.float32) if a.q.shape[1] <= 1024 else b.q
    for at in range(0, len(a.ids), TILE_ROWS):
        rows = slice(at, at + TILE_ROWS)
        whole = products(a.q[rows], wide)
        # every pair that its own bound could let through passes with the block's worst one
        least = (threshold - SLACK - a.length[rows] * worst - a.error[rows]) / a.step[rows]
        i, j = np.nonzero(whole * b.step.astype(whole.dtype) >= (least - 1e-6 * np.abs(least)).astype(whole.dtype)[:, None])
        if same:
            i, j = i[i + at < j], j[i + at < j]
        near = whole[i, j].astype(np.float64)
        i = i + at
        near *= a.step[i] * b.step[j]
        bound = a.length[i] * b.error[j] + a.error[i] + SLACK
        linked = near - bound >= threshold
        open_ = np.flatnonzero(~linked & (near + bound >= threshold))
        for k in range(0, len(open_), 1 << 14):
            some = open_[k : k + (1 << 14)]
            exact = np.einsum("ij,ij->i", a.x[i[some]], b.x[j[some]]) / np.sqrt(a.square[i[some]]) / np.sqrt(b.square[j[some]])
            linked[some] = exact >= threshold
        if computed is not None:
            computed.append(len(open_))
        yield i[linked], j[linked]


def merged(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels, each a position, after joining the positions of all pairs (i, j)."""
    while True:
        one, two = labels[i], labels[j]
        apart = one != two
        if not apart.any():
            return labels
        i, j = i[apart], j[apart]
        np.minimum.at(labels, np.maximum(one, two)[apart], np.minimum(one, two)[apart])
        while (labels[labels] != labels).any():
            labels = labels[labels]


_FOUND = "node long, links long, top long"


def _compared(threshold: float) -> Callable[[pa.Table], pa.Table]:
    def compare(pair: pa.Table) -> pa.Table:
        pair = pair.combine_chunks()
        left = pair.column("left").to_numpy()
        ids, members = pair.column("node").to_numpy(), pair.column("members").to_numpy()
        x = pair.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        same = pair.column("i")[0].as_py() == pair.column("j")[0].as_py()
        sides = [Block(ids[s], members[s], x[s]) for s in ((left,) if same else (left, ~left)) if s.any()]
        none = pa.table({c: pa.array([], pa.int64()) for c in ("node", "links", "top")})
        if len(sides) == 1 and not same:
            return none
        a, b = sides[0], sides[-1]
        shift = 0 if same else len(a.ids)
        every = a.ids if same else np.concatenate([a.ids, b.ids])
        labels, links = np.arange(len(every)), np.zeros(len(every), np.int64)
        for i, j in tile_links(a, b, same, threshold):
            links += np.bincount(i, b.members[j], len(every)).astype(np.int64) + np.bincount(j + shift, a.members[i], len(every)).astype(np.int64)
            labels = merged(labels, i, j + shift)
        some = np.flatnonzero(links)
        return pa.table({"node": every[some], "links": links[some], "top": every[labels[some]]}) if len(some) else none

    return compare


def _pairs(classes: DataFrame) -> DataFrame:
    """classes(node, members, v) dealt to all pairs of blocks: d, i, j, left, node, members, v."""
    rows = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("d"))))
    blocks = classes.groupBy("d").agg(F.count(F.lit(1)).alias("n")).select("d", F.ceil(F.col("n") / rows).cast("int").alias("blocks"))  # a row for each length
    dealt = classes.join(F.broadcast(blocks), "d").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # with itself and those after it as the first of a pair, with those before it as the second
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = dealt.select("d", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("left"), "node", "members", "v")
    return pair


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = []
        for v in batch.column(1):
            x = v.values
            digests.append(None if x is None else hashlib.blake2b((x.to_numpy(zero_copy_only=False) + 0.0).tobytes(), digest_size=16).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), batch.column(1)], names=["vec_id", "set_id", "v"])


def links(rows: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Of rows(vec_id, set_id, v): stored classes (set_id, node, members, first_id, d, v) and stored found(node, links, top).

    ``found`` has a row for each class and block pair in which it has links:
    the vectors it is linked with there, and a class of the same component.
    """
    equal = rows.filter("set_id is not null").groupBy("set_id").agg(F.count(F.lit(1)).alias("members"), F.min("vec_id").alias("first_id"), F.first("v").alias("v"))
    classes = materialize(equal.withColumn("d", F.size("v")).withColumn("node", F.monotonically_increasing_id()), "classes")
    pairs = _pairs(classes.select("d", "node", "members", "v")).groupBy("d", "i", "j").applyInArrow(_compared(threshold), _FOUND)
    return classes, materialize(pairs, "found")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold: above 0, at most 1")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(usable(F.col("v")), F.col("v")))
    rows = materialize(rows.mapInArrow(_digests, "vec_id long, set_id string, v array<double>"), "rows")
    classes, found = links(rows, threshold)
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = graph.components(found.filter("node <> top").select(F.col("node").alias("a"), F.col("top").alias("b")), grows=True)
    named = meet(meet(classes.select("set_id", "node", "members", "first_id"), linked, "node", "left"), comps, "node", "left")
    named = materialize(named.withColumn("comp", F.coalesce("comp", "node")), "named")
    first = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = salted_join(named, first, "comp", salt="node", grows=True).select("set_id", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = salted_join(rows.select("vec_id", "set_id"), named, "set_id", "left", salt="vec_id", grows=True)
    alone = F.col("set_id").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, c.c = e.vec_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
