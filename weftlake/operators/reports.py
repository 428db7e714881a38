"""Run reports, method shares and recent rows, as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def method_breakdown(records: DataFrame, created: str, method: str, as_of: Column, days: int = 7) -> DataFrame:
    """Records of the last days by method."""
    recent = records.filter(F.col(created) >= as_of - F.make_dt_interval(F.lit(days)))
    return recent.groupBy(F.coalesce(F.col(method), F.lit("unknown")).alias("method")).agg(F.count(F.lit(1)).alias("n"))


def avoidance_rate(records: DataFrame, method: str, model: str) -> DataFrame:
    """The share of records that needed no model, 3 decimals; null without records."""
    return records.agg(F.round(1 - F.count_if(F.col(method) == model) / F.nullif(F.count(F.lit(1)), F.lit(0)), 3).alias("avoidance"), F.count(F.lit(1)).alias("records"))


def run_report(items: DataFrame, job: str, ok: Column, kind: str, method: str) -> DataFrame:
    """Per job: submitted, succeeded, failed and counts by kind (all) and by method (succeeded)."""
    by = lambda c, only, name: items.filter(only).groupBy(job, F.coalesce(F.col(c), F.lit("unknown")).alias("_by")).agg(F.count(F.lit(1)).alias("n")).groupBy(job).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_by", "n")))).alias(name))
    head = items.groupBy(job).agg(F.count(F.lit(1)).alias("submitted"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))
    return head.join(by(kind, F.lit(True), "by_kind"), job, "left").join(by(method, ok, "by_method"), job, "left")


def timers(df: DataFrame, name: str, seconds: str) -> DataFrame:
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.sum(seconds).alias("total"), F.avg(seconds).alias("mean"), F.max(seconds).alias("most"))


def recent(records: DataFrame, created: str, tie: str, limit: int = 25) -> DataFrame:
    """Newest rows first."""
    return records.orderBy(F.desc(created), F.desc(tie)).limit(limit)


def cache_stats(probed: DataFrame, hit: Column) -> DataFrame:
    n = F.count(F.lit(1))
    return probed.agg(n.alias("probes"), F.count_if(hit).alias("hits"), F.round(F.count_if(hit) / F.nullif(n, F.lit(0)), 3).alias("hit_rate"))


def limiter_stats(waits: DataFrame) -> DataFrame:
    """Of ``ordered.limited``: requests, how many waited, seconds waited together and at most."""
    return waits.agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("waited") > 0).alias("delayed"), F.round(F.sum("waited"), 3).alias("waited"), F.round(F.max("waited"), 3).alias("longest"))


def breaker_stats(states: DataFrame, host: str = "host", seq: str = "seq") -> DataFrame:
    """Of ``ordered.breaker_states``: hosts, hosts that opened, trips, and records met by a circuit that was not closed."""
    before = F.lag("state").over(Window.partitionBy(host).orderBy(seq))
    trips = states.withColumn("_trip", (F.col("state") == "open") & F.coalesce(before != "open", F.lit(True)))
    by = trips.groupBy(host).agg(F.count_if("_trip").alias("_t"), F.count_if(F.col("state") != "closed").alias("_o"))
    return by.agg(F.count(F.lit(1)).alias("hosts"), F.count_if(F.col("_t") > 0).alias("opened"), F.sum("_t").alias("trips"), F.sum("_o").alias("not_closed"))


def duplicate_stats(found: DataFrame) -> DataFrame:
    """Of a duplicate check: documents, exact and near duplicates, and the share that was new."""
    n = F.count(F.lit(1))
    return found.agg(n.alias("documents"), F.count_if(F.col("distance") == 0).alias("exact"), F.count_if(F.col("distance") > 0).alias("near"), F.round(F.count_if(F.col("distance").isNull() | (F.col("distance") < 0)) / F.nullif(n, F.lit(0)), 3).alias("new"))
