"""Rendezvous (highest random weight) sharding of stable record keys.

Every shard draws a pseudo-random number from the record's key and its own
number; the record goes to the shard with the highest score.  The law is a pure
function of (key, shards), so tasks need no state and a new shard can only win
records for itself: on average 1/(n+1) of them move and none moves elsewhere.

Weighted shards use ``-weight / ln(u)`` with u uniform in (0, 1), so a shard's
share is proportional to its weight.

Defined results: a null key is a key like any other (all null keys share one
shard); repeated keys share a shard and take consecutive slots; an empty table
gives an empty result; other columns are passed through untouched, and a column
of the input whose name clashes with a result column is replaced by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Slots are numbered within parts of a shard; parts * shards bounds the table of offsets.
SLOT_PARTS = 1024


def score(key: Column, shard: Column, weight: Column | None = None) -> Column:
    """The score of one shard for one key: a 64-bit hash, or -w/ln(u) when weighted."""
    h = F.xxhash64(key, shard.cast("long"))
    if weight is None:
        return h
    # in the hash's own order, so that equal weights deal as no weights do
    u = (F.shiftright(h, 12).cast("double") + F.lit(float(1 << 51) + 0.5)) / F.lit(float(1 << 52))
    return -weight / F.ln(u)


def rendezvous(key: Column, shards: int, weights: Sequence[float] | None = None) -> Column:
    """The shard (int, 0 to shards-1) with the highest score; ties to the larger number."""
    if weights is None:
        drawn = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(score(key, s).alias("score"), s.alias("shard")))
    else:
        pairs = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])
        drawn = F.transform(pairs, lambda p: F.struct(score(key, p["shard"], p["weight"]).alias("score"), p["shard"].alias("shard")))
    return F.array_max(drawn)["shard"]


def shard_records(df: DataFrame, key: str, shards: int, weights: Sequence[float] | None = None, into: str = "shard") -> DataFrame:
    """Add ``into``: the record's shard.  A projection; nothing is shuffled."""
    return df.withColumn(into, rendezvous(F.col(key), shards, weights))


def with_slots(df: DataFrame, shard: str, spread: Sequence[str], into: str = "slot", parts: int = SLOT_PARTS) -> DataFrame:
    """Add a gapless 0-based number within each shard.

    A shard of a large table is too big for one task, so rows are numbered
    within ``parts`` hashed parts of each shard and moved up by the sizes
    of the parts before; the offsets are one row per shard and part.  ``df``
    must be stable when read twice (a stored table).
    """
    part = df.withColumn("_part", F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(parts)).cast("int"))
    sizes = part.groupBy(shard, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(shard).alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    order = Window.partitionBy(shard, "_part").orderBy(*spread)
    # the numbered rows are dealt by the join's keys already; at most shards * parts offsets come to them
    joined = part.withColumn("_rank", F.row_number().over(order) - 1).join(offsets, (F.col(shard) == F.col("_s")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn(into, (F.col("_base") + F.col("_rank")).cast("long")).drop("_part", "_s", "_p", "_base", "_rank")


def shard_documents(documents: DataFrame, shards: int = 40, weights: Sequence[float] | None = None, new_weight: float = 1.0) -> DataFrame:
    """Law ``key`` over documents: shard, slot in it, and the shard with one more.

    ``weights``: of the shards, equal by default; ``new_weight``: of the one that is added.
    """
    weights = list(weights) if weights is not None else [1.0] * shards
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = documents.select("doc_id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    key = F.col("doc_id")
    drawn = shard_records(digest, "doc_id", shards, weights)
    own = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("shard") + 1)
    new = score(key, F.lit(shards), F.lit(float(new_weight))) >= score(key, F.col("shard"), own)
    drawn = drawn.withColumn("grown_shard", F.when(new, F.lit(shards)).otherwise(F.col("shard")))
    placed = with_slots(materialize(drawn, "shards"), "shard", ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
