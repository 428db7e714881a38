"""Table maintenance without a merge statement: upserts, expiry, caches, content-addressed bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(rows: DataFrame, keys: Sequence[str], order: Sequence[str], first_seen: str | None = None) -> DataFrame:
    """The latest row of each key (nulls are equal), with the time of its first.

    A maximum over a struct: partial aggregation before the shuffle, so a key with
    many versions sends one row per task.
    """
    rest = [c for c in rows.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    more = [F.min(first_seen).alias("first_seen")] if first_seen else []
    out = rows.groupBy(*keys).agg(latest, *more)
    return out.select(*keys, "_row.*", *(["first_seen"] if first_seen else []))


def merge_into(spark, path: str, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> None:
    """Stored rows and new ones, the latest of each key, written beside the table and moved in its place.

    The old table is moved aside before the new one takes its place and goes
    last, so whatever ends a run, one whole version is there: the next run
    brings an old one back where nothing has taken its place.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target, fresh, old = (hadoop.Path(path + end) for end in ("", ".next", ".old"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(old) and not fs.exists(target):
        fs.rename(old, target)
    rows = spark.read.parquet(path).unionByName(new) if fs.exists(target) else new
    upsert(rows, keys, order).write.mode("overwrite").parquet(path + ".next")
    fs.delete(old, True)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"{path} cannot be moved aside")
    if not fs.rename(fresh, target):
        raise OSError(f"{path}.next cannot take the table's place")
    fs.delete(old, True)


def live(rows: DataFrame, stamp: str, as_of: Column, seconds: int) -> DataFrame:
    """Rows that have not expired."""
    return rows.filter(F.col(stamp) + F.make_dt_interval(secs=F.lit(seconds)) > as_of)


def cache_join(items: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Items with ``cached`` and their cached values; the cache has one row per key."""
    values = cache.withColumn("cached", F.lit(True))
    return items.join(values, key, "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def missing(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows to append: one for each key that is not stored."""
    return rows.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def storable(status: Column, headers: Column) -> Column:
    """Whether a response may be cached: 200, a validator, and not forbidden."""
    has = lambda h: F.try_element_at(headers, F.lit(h)).isNotNull()
    return (status == 200) & (has("etag") | has("last-modified")) & ~F.coalesce(F.lower(F.try_element_at(headers, F.lit("cache-control"))).contains("no-store"), F.lit(False))


def validators(headers: Column) -> Column:
    """Conditional request headers from a cached response's."""
    pair = F.create_map(F.lit("if-none-match"), F.try_element_at(headers, F.lit("etag")), F.lit("if-modified-since"), F.try_element_at(headers, F.lit("last-modified")))
    return F.map_filter(pair, lambda k, v: v.isNotNull())
