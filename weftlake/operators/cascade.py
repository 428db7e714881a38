"""The extraction cascade: cheapest tier first, each later tier only on what is left.

Tiers are joins, filters and unions over the residual, not branches of one CASE:
Spark may evaluate a UDF in every branch of a CASE, but never on filtered rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import structured
from ..functions.schema import wants_list

ACCEPT = 0.5
MAX_TEXT = 12_000
Backend = Callable[[str, dict], dict]


def fill(hint: dict) -> Column:
    full = [F.when((F.size(F.col(f)) > 0) if wants_list(h) else (F.trim(F.col(f)) != ""), 1.0).otherwise(0.0) for f, h in hint.items()]
    return sum(full[1:], full[0]) / len(full)


def _accepted(df: DataFrame, method: str, tier: int) -> DataFrame:
    df = df if "warning" in df.columns else df.withColumn("warning", F.lit(None).cast("string"))
    return df.withColumn("method", F.lit(method)).withColumn("tier", F.lit(tier)).withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "fill")), 3))


def structured_tier(items: DataFrame, hint: dict, *sources: Column) -> DataFrame:
    """Tier 1 alone, as a projection: the hint's fields from the sources, fill, method, tier, confidence."""
    mapped = items.withColumns({f: structured.find_value(f, h, *sources) for f, h in hint.items()}).withColumn("fill", fill(hint))
    good = F.coalesce(F.col("fill") >= ACCEPT, F.lit(False))
    fields = {f: F.when(good, F.col(f)) for f in hint}
    named = {"method": F.when(good, F.lit("structured")), "tier": F.when(good, F.lit(1)), "confidence": F.when(good, F.round(F.least(F.lit(1.0), "fill"), 3)).otherwise(0.0)}
    return mapped.withColumns(fields | named)


def run(items: DataFrame, hint: dict, *, cache: DataFrame | None = None, specs: Callable[[DataFrame], DataFrame] | None = None, backend: Backend | None = None, tiers: Sequence[int] = (0, 1, 2, 3), tier1_requires_markup: bool = True) -> DataFrame:
    """items(id, cache_key, flat MAP, metadata MAP, text) -> id, fields, fill, method, tier, confidence.

    ``cache``: cache_key and the fields, one row per key.  ``specs``: replays
    selector rules on the residual and returns id and fields.  ``backend``: a
    model behind a callable, run in Arrow batches on what no tier answered.
    Rows without an answer come back with method null; ``warning`` tells of a text
    that was cut for the model.
    """
    names, done, left = list(hint), [], items
    out = ["id", *names, "fill", "method", "tier", "confidence", "warning"]
    if cache is not None and 0 in tiers:
        probed = left.join(cache.select("cache_key", *names, F.lit(True).alias("_hit")), "cache_key", "left")
        hit = probed.filter("_hit").withColumn("fill", fill(hint))
        done.append(_accepted(hit, "cache", 0).select(*out))
        left = probed.filter("_hit is null").drop(*names, "_hit")
    if 1 in tiers:
        mapped = left.withColumns({f: structured.find_value(f, h, F.col("flat"), F.col("metadata")) for f, h in hint.items()}).withColumn("fill", fill(hint))
        markup = F.size("flat") > 0 if tier1_requires_markup else F.lit(True)
        good = F.coalesce(markup & (F.col("fill") >= ACCEPT), F.lit(False))
        done.append(_accepted(mapped.filter(good), "structured", 1).select(*out))
        left = mapped.filter(~good).drop(*names, "fill")
    if specs is not None and 2 in tiers:
        replayed = left.join(specs(left).select("id", *names), "id", "left").withColumn("fill", fill(hint))
        done.append(_accepted(replayed.filter(F.col("fill") >= ACCEPT), "selector", 2).select(*out))
        left = replayed.filter(F.col("fill") < ACCEPT).drop(*names, "fill")
    if backend is not None and 3 in tiers:

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [backend(t or "", hint) for t in b["text"]]
                yield pd.DataFrame({"id": b["id"], **{n: [r.get(n) for r in rows] for n in names}})

        kinds = ", ".join(f"`{n}` {'array<string>' if wants_list(h) else 'string'}" for n, h in hint.items())
        asked = left.select("id", F.substring("text", 1, MAX_TEXT).alias("text")).mapInPandas(ask, f"id long, {kinds}")
        cut = F.when(F.length("text") > MAX_TEXT, F.concat(F.lit("text of "), F.length("text").cast("string"), F.lit(f" characters was cut to {MAX_TEXT}")))
        asked = asked.join(left.select("id", cut.alias("warning")).filter("warning is not null"), "id", "left")
        done.append(_accepted(asked.withColumn("fill", fill(hint)), "llm", 3).select(*out))
    else:
        empty = {n: F.lit(None).cast("array<string>" if wants_list(h) else "string") for n, h in hint.items()}
        rest = left.withColumns(empty).withColumn("fill", F.lit(0.0))
        done.append(rest.withColumn("method", F.lit(None).cast("string")).withColumn("tier", F.lit(None).cast("int")).withColumn("confidence", F.lit(0.0)).withColumn("warning", F.lit(None).cast("string")).select(*out))
    answer = done[0]
    for d in done[1:]:
        answer = answer.unionByName(d)
    return answer


def to_store(answers: DataFrame, items: DataFrame, hint: dict) -> DataFrame:
    """What the next run's cache should hold of this one: cache_key and the fields of answers that did not come from the cache, one row a key."""
    new = answers.filter(F.col("method").isNotNull() & (F.col("method") != "cache")).select("id", *hint)
    keyed = items.filter("cache_key is not null").select("id", "cache_key").join(new, "id")
    return keyed.groupBy("cache_key").agg(F.min_by(F.struct(*hint), "id").alias("_a")).select("cache_key", "_a.*")
