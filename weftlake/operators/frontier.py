"""Crawls over stored link tables: one round per level, novelty by anti-join, a budget of claims."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import stored


def claim(found: DataFrame, seen: DataFrame, room: int) -> DataFrame:
    """``found(url, depth)`` that are new, each once at its smallest depth, the first ``room`` by (depth, url)."""
    new = found.groupBy("url").agg(F.min("depth").alias("depth")).join(seen.select("url"), "url", "left_anti")
    return new.orderBy("depth", "url").limit(room)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def reach(seeds: DataFrame, links: DataFrame, max_depth: int, max_pages: int | None = None) -> DataFrame:
    """url, depth of pages reached from ``seeds(url)`` over ``links(src, dst)``.

    Stops at the depth, the budget or an empty round; only counts come to the
    driver.  A round stores what is new alone: what was seen is the rounds together.
    """
    first = seeds.select("url", F.lit(0).alias("depth"))
    wave = stored(claim(first, seeds.select("url").limit(0), max_pages) if max_pages else first.distinct())
    rounds, claimed = [wave], wave.count() if max_pages else 0
    for depth in range(1, max_depth + 1):
        if max_pages and claimed >= max_pages:
            break
        found, seen = links.join(wave.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url"), F.lit(depth).alias("depth")), _union(rounds)
        wave = stored(claim(found, seen, max_pages - claimed) if max_pages else found.distinct().join(seen.select("url"), "url", "left_anti"))
        n = wave.count()
        if not n:
            break
        claimed += n
        rounds.append(wave)
    return _union(rounds)


#: Parts of a novelty index, bits for each url, probes of a url.
PARTS, BITS, PROBES = 64, 12, 8


def _places(one: np.ndarray, two: np.ndarray, size: int) -> np.ndarray:
    """(url, probe) positions in a filter of ``size`` bits, from two hashes."""
    steps = np.arange(PROBES, dtype=np.uint64)
    return (one.view(np.uint64)[:, None] + steps * (two.view(np.uint64) | np.uint64(1))[:, None]) % np.uint64(size)


def _hashed(urls: DataFrame, parts: int) -> DataFrame:
    one, two = F.xxhash64("url"), F.xxhash64(F.lit(1), "url")
    return urls.select("url", F.pmod(F.xxhash64(F.lit(2), "url"), F.lit(parts)).cast("int").alias("part"), one.alias("one"), two.alias("two"))


def seen_filters(urls: DataFrame, parts: int = PARTS) -> DataFrame:
    """part, size, bits: a Bloom filter over the urls of each part, BITS for each of them."""

    def build(rows: pa.Table) -> pa.Table:
        size = 8 * max(8, len(rows) * BITS // 8 + 1)
        bits = np.zeros(size, bool)
        one, two = (rows.column(c).combine_chunks().to_numpy() for c in ("one", "two"))
        for at in range(0, len(rows), 1 << 16):
            bits[_places(one[at : at + (1 << 16)], two[at : at + (1 << 16)], size).ravel()] = True
        return pa.table({"part": rows.column("part").slice(0, 1), "size": pa.array([size], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    return _hashed(urls, parts).select("part", "one", "two").groupBy("part").applyInArrow(build, "part int, size long, bits binary")


def novel(found: DataFrame, seen: DataFrame, filters: DataFrame, parts: int = PARTS) -> DataFrame:
    """Distinct urls of ``found`` that are not in ``seen``, told apart by the filters of its rounds first.

    A url that no filter holds is new for certain; only the others, repeated
    ones and some 1 in 300 of the new, meet ``seen`` in a join.  A part's urls
    and its filters, one for each round, are one task's.
    """

    def probe(rows: pa.Table, held: pa.Table) -> pa.Table:
        one, two = (rows.column(c).combine_chunks().to_numpy() for c in ("one", "two"))
        may = np.zeros(len(one), bool)
        for size, raw in zip(held.column("size").to_pylist(), held.column("bits").to_pylist()):
            bits = np.unpackbits(np.frombuffer(raw, np.uint8))
            for at in range(0, len(one), 1 << 16):
                may[at : at + (1 << 16)] |= bits[_places(one[at : at + (1 << 16)], two[at : at + (1 << 16)], size)].all(1)
        return pa.table({"url": rows.column("url"), "may": pa.array(may)})

    asked = _hashed(found.select("url").distinct(), parts)
    told = stored(asked.groupBy("part").cogroup(filters.groupBy("part")).applyInArrow(probe, "url string, may boolean"))
    return told.filter("not may").select("url").unionByName(told.filter("may").select("url").join(seen.select("url"), "url", "left_anti"))


def redirect_targets(redirects: DataFrame, hops: int = 10) -> DataFrame:
    """``redirects(src, dst)`` -> src, target, hops: where chains of at most ``hops`` end."""
    at = redirects.select("src", F.col("dst").alias("target"), F.lit(1).alias("hops"))
    step = redirects.select(F.col("src").alias("target"), F.col("dst").alias("_next"))
    for _ in range(hops - 1):
        at = at.join(step, "target", "left").select("src", F.coalesce("_next", "target").alias("target"), (F.col("hops") + F.col("_next").isNotNull().cast("int")).alias("hops"))
    return at


def top_reasons(skipped: DataFrame, by: str | None = None, most: int = 5) -> DataFrame:
    """Reasons of skipped links with their counts, the most frequent first; of all or of each ``by``."""
    keys = [by, "reason"] if by else ["reason"]
    n = skipped.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if not by:
        return n.orderBy(F.desc("n"), "reason").limit(most)
    return n.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "reason"))).filter(F.col("_k") <= most).drop("_k")
