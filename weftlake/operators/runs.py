"""Runs: failures, children, dispatch by kind, reports, dead letters, sinks and caches as table operations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import storable

# Errors that another try may mend.
TRANSIENT = ("TransientFetchError", "RateLimited", "CircuitOpen", "TransientExtractError")
LEARN_ATTEMPTS = 2


def failure(stage: Column, error_type: Column, message: Column) -> Column:
    """STRUCT<stage,error_type,error,transient>, or null where nothing failed."""
    return F.when(message.isNotNull(), F.struct(stage.alias("stage"), error_type.alias("error_type"), message.alias("error"), F.coalesce(error_type.isin(*TRANSIENT), F.lit(False)).alias("transient")))


def dispatch(items: DataFrame, kind: str, handlers: dict[str, Callable[[DataFrame], DataFrame]], default: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Items of each kind through its handler, the rest through ``default``; columns that a handler lacks are null."""
    parts = [h(items.filter(F.col(kind) == k)) for k, h in handlers.items()]
    if default:
        parts.append(default(items.filter(F.coalesce(~F.col(kind).isin(*handlers), F.lit(True)))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def split_children(items: DataFrame, children: str, max_depth: int, depth: str = "depth") -> tuple[DataFrame, DataFrame]:
    """Children that carry bytes, to run at once one level deeper, and addresses that were only discovered.

    ``children``: ARRAY<STRUCT<url,raw>>; at ``max_depth`` none are followed.
    """
    each = items.filter(F.col(depth) < max_depth).select(F.col("url").alias("parent_url"), (F.col(depth) + 1).alias(depth), F.explode(children).alias("c"))
    inline = each.filter("c.raw is not null").select("parent_url", depth, "c.url", "c.raw")
    return inline, each.filter("c.raw is null").select("parent_url", depth, "c.url")


def with_children(parents: DataFrame, *children: DataFrame) -> DataFrame:
    """Records of items and of their children as one stream."""
    out = parents
    for c in children:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def report(items: DataFrame, job: str, ok: Column, kind: str, method: str, error: str, warnings: str, timings: str) -> DataFrame:
    """One row per job: counts, counts by kind (all) and method (succeeded), errors, distinct warnings, summed timings.

    Everything is counted per value before it meets in a map, so a job with a
    third of all items sends one row per value and task; ``errors`` are counted
    by what they say.
    """

    def tally(values: DataFrame, name: str, total: Column) -> DataFrame:
        return values.groupBy(job, "_by").agg(total.alias("n")).groupBy(job).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_by", "n")))).alias(name))

    count = F.count(F.lit(1))
    head = items.groupBy(job).agg(count.alias("submitted"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))
    named = lambda c: F.coalesce(F.col(c), F.lit("unknown")).alias("_by")
    parts = [
        tally(items.select(job, named(kind)), "by_kind", count),
        tally(items.filter(ok).select(job, named(method)), "by_method", count),
        tally(items.filter(~ok).select(job, F.col(error).alias("_by")).filter("_by is not null"), "errors", count),
        tally(items.select(job, F.explode(timings).alias("_by", "_ms")), "timings_ms", F.round(F.sum("_ms"), 2)),
        items.select(job, F.explode(warnings).alias("w")).distinct().groupBy(job).agg(F.array_sort(F.collect_list("w")).alias("warnings")),
    ]
    for p in parts:
        head = head.join(p, job, "left")
    return head


def counters(items: DataFrame, by: Sequence[str], **conditions: Column) -> DataFrame:
    """Named counters of a log, per key."""
    return items.groupBy(*by).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in conditions.items()])


def dead_letters(items: DataFrame, failed: Column, columns: Sequence[str], newest: Sequence[str], limit: int = 50) -> DataFrame:
    """Failed items, the newest first."""
    return items.filter(failed).orderBy(*[F.desc(c) for c in newest]).select(*columns).limit(limit)


def append_lines(records: DataFrame, path: str, kind: str | None = None) -> None:
    """Records as JSON lines beside those that are there; one folder for each record type if ``kind`` names it."""
    out = records.write.mode("append")
    (out.partitionBy(kind) if kind else out).json(path)


def tail(spark, path: str, schema: str, newest: Sequence[str], limit: int, needed: str) -> DataFrame:
    """The newest readable records of JSON lines; lines without ``needed`` are none."""
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return rows.filter(F.col(needed).isNotNull()).orderBy(*[F.desc(c) for c in newest]).limit(limit)


def http_cache_step(responses: DataFrame, cache: DataFrame, key: str = "url") -> DataFrame:
    """Responses(url, status, headers, body) against cache(url, headers, body): outcome, and the body that counts.

    A 304 takes the stored body (without one it fails); a 200 with a validator
    is stored; the rest passes.
    """
    kept = cache.select(key, F.col("body").alias("_body"), F.lit(True).alias("_known"))
    joined = responses.join(kept, key, "left")
    outcome = F.when((F.col("status") == 304) & F.col("_known"), "revalidated").when(F.col("status") == 304, "missing").when(storable(F.col("status"), F.col("headers")), "stored").otherwise("passed")
    body = F.when(F.col("status") == 304, F.col("_body")).otherwise(F.col("body"))
    return joined.withColumn("outcome", outcome).withColumn("body", body).drop("_body", "_known")


def evict(cache: DataFrame, stamp: str, tie: str, keep: int = 512) -> DataFrame:
    """The newest ``keep`` entries."""
    return cache.orderBy(F.desc(stamp), F.desc(tie)).limit(keep)


def waits(requests: DataFrame, host: str, seconds: str, order: Sequence[str], gap: float) -> DataFrame:
    """Seconds that each request has to wait for the gap after the one before it on its host, as the log has it."""
    before = F.lag(seconds).over(Window.partitionBy(host).orderBy(*order))
    return requests.withColumn("wait", F.greatest(F.lit(0.0), F.coalesce(F.lit(gap) - (F.col(seconds) - before), F.lit(0.0))))


def learn_attempts(failures: DataFrame, keys: Sequence[str], most: int = LEARN_ATTEMPTS) -> DataFrame:
    """Failed attempts per key, and whether another one is still worth a call."""
    return failures.groupBy(*keys).agg(F.count(F.lit(1)).alias("attempts")).withColumn("should_learn", F.col("attempts") < most)


def column_pivot(rows: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Records of a list as columns: of each the first filled value and all filled ones in order."""
    full = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    lists = [F.array_sort(F.collect_list(F.when(full(c), F.struct(order, c)))).alias(c) for c in columns]
    out = rows.groupBy(key).agg(*lists)
    values = {c: F.col(f"{c}.{c}") for c in columns}
    return out.select(key, *[F.get(v, F.lit(0)).alias(c) for c, v in values.items()], *[v.alias(f"{c}__column") for c, v in values.items()])


def drift_report(observations: DataFrame, key: str, filled: dict[str, Column], baselines: DataFrame | None = None) -> DataFrame:
    """key, field, seen, current fill rate (3 decimals), and the stored baseline of the key's field."""
    sums = observations.groupBy(key).agg(F.count(F.lit(1)).alias("seen"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(f) for f, c in filled.items()])
    long = sums.select(key, "seen", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.round(F.col(f) / F.col("seen"), 3).alias("current")) for f in filled])).alias("x")).select(key, "x.field", "seen", "x.current")
    return long.join(baselines, [key, "field"], "left") if baselines is not None else long


def summary(items: DataFrame, columns: Sequence[str], children: str | None = None) -> DataFrame:
    """What may leave the engine of an item: no bytes and no full text, confidence to 3 decimals, children as a number."""
    kept = [F.round(c, 3).alias(c) if c == "confidence" else F.col(c) for c in columns]
    return items.select(*kept, *([F.coalesce(F.size(children), F.lit(0)).alias("children")] if children else []))


# A record's provenance, in order.
PROVENANCE = (
    "source_url", "canonical_url", "final_url", "redirect_chain", "http_status", "content_type", "content_length", "content_hash", "etag", "last_modified", "kind", "fetch_mode", "handler",
    "method", "tier", "confidence", "schema_hash", "prompt_hash", "job_id", "parent_url", "timings_ms", "warnings",
)


def provenance(have: dict[str, Column]) -> Column:
    """The STRUCT that travels with a record; parts that are not known are null."""
    unknown = set(have) - set(PROVENANCE)
    if unknown:
        raise ValueError(f"not parts of a provenance: {sorted(unknown)}")
    return F.struct(*[(have[k] if k in have else F.lit(None).cast("string")).alias(k) for k in PROVENANCE])
