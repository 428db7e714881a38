"""Joins in time: the last version at or before a moment, and starts paired with ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a stretch of time; a key's rows of one stretch are ordered by one task.
STRETCH = 3600.0


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def as_of_join(asks: DataFrame, versions: DataFrame, key: str, at: str, since: str, valid: float | None = None, stretch: float = STRETCH) -> DataFrame:
    """The columns of ``asks`` and ``version``: a struct of the last row of ``versions`` of the same key at or before ``at``.

    ``key`` is in both tables; ``at`` and ``since`` are their timestamps.  With
    ``valid``, a version that is as many seconds old or older is none.  Both
    tables meet in one union, cut into stretches of time, so a hot key is many
    groups: within a stretch the last version is a running value, from earlier
    ones a stretch takes over one row, found among one row for each stretch.
    Of versions at one moment the greatest row counts.  Asks without key or
    time, and asks before any version, come back with a null ``version``.
    """
    ask = asks.select(F.col(key).alias("_k"), micros(F.col(at)).alias("_t"), F.lit(1).alias("_side"), F.struct(*asks.columns).alias("_a"))
    kept = versions.filter(F.col(key).isNotNull() & F.col(since).isNotNull())
    version = kept.select(F.col(key).alias("_k"), micros(F.col(since)).alias("_t"), F.lit(0).alias("_side"), F.struct(*versions.columns).alias("_v"))
    whole = F.col("_k").isNotNull() & F.col("_t").isNotNull()
    rows = ask.filter(whole).unionByName(version, allowMissingColumns=True).withColumn("_s", F.floor(F.col("_t") / F.lit(stretch * 1e6)))
    so_far = Window.partitionBy("_k", "_s").orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    stretches = rows.groupBy("_k", "_s").agg(F.max(F.when(F.col("_side") == 0, F.struct("_t", "_v"))).alias("_m"))
    stretches = stretches.withColumn("_before", F.last("_m", ignorenulls=True).over(earlier)).filter("_before is not null").select("_k", "_s", "_before")
    inside = rows.withColumn("_in", F.last(F.when(F.col("_side") == 0, F.struct("_t", "_v")), ignorenulls=True).over(so_far)).filter("_side = 1")
    found = inside.join(stretches, ["_k", "_s"], "left").withColumn("_m", F.coalesce("_in", "_before"))
    fresh = F.col("_t") - F.col("_m._t") < F.lit(int(valid * 1e6)) if valid is not None else F.lit(True)
    out = found.select("_a", F.when(fresh, F.col("_m._v")).alias("version"))
    rest = ask.filter(~whole | F.col("_k").isNull() | F.col("_t").isNull()).select("_a", F.lit(None).cast(out.schema["version"].dataType).alias("version"))
    return out.unionByName(rest).select("_a.*", "version")


def with_timeouts(starts: DataFrame, ends: DataFrame, key: str, at: str, until: str, seconds: int, late: str | None = None) -> DataFrame:
    """``starts`` joined with the ``ends`` of the same key at most ``seconds`` later; a start without one has nulls.

    The same for tables and streams: for streams ``late`` sets the watermarks of
    both sides, state is kept for the interval only, and a start without an end
    comes out as a timeout once the watermark is past its interval.  ``ends``
    has no column of ``starts`` but the key, which it gives up.
    """
    if late is not None:
        starts, ends = starts.withWatermark(at, late), ends.withWatermark(until, late)
    ends = ends.withColumnRenamed(key, "_key")
    near = (F.col(key) == F.col("_key")) & (F.col(until) >= F.col(at)) & (F.col(until) <= F.col(at) + F.expr(f"INTERVAL {int(seconds)} SECONDS"))
    return starts.join(ends, near, "leftouter").drop("_key")


def first_end(pairs: DataFrame, start: str, until: str) -> DataFrame:
    """Of ``with_timeouts`` over tables: start, its earliest end or null, and how many there are."""
    return pairs.groupBy(start).agg(F.min(until).alias("ended"), F.count(until).alias("ends"))


def age_seconds(at: Column, since: Column) -> Column:
    return (micros(at) - micros(since)) / F.lit(1_000_000.0)
