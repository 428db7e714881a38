"""Learned selector specs as one versioned table: learned, used, judged, retired.

A row is a version of a spec (key, rules, when learned) with the running figures
of its uses: how many, their moving average of fill, the last one.  What is in
force of a key is its newest version that is not retired.  All steps are joins
of the stored table with a batch, so batches in order give what one pass gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordered

COLUMNS = "key string, version int, rules string, learned timestamp, n long, ema double, last_used timestamp, retired timestamp"
#: Attempts to learn a key that fail before it is left alone.
MAX_ATTEMPTS = 2


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], COLUMNS)


def current(specs: DataFrame) -> DataFrame:
    """The version in force of each key."""
    newest = specs.filter("retired is null").groupBy("key").agg(F.max("version").alias("version"))
    return specs.join(newest, ["key", "version"])


def learn(specs: DataFrame, learned: DataFrame) -> DataFrame:
    """``learned(key, rules, learned)``, one row a key: new versions for keys that have none in force."""
    last = specs.groupBy("key").agg(F.max("version").alias("_v"), F.max(F.col("retired").isNull()).alias("_open"))
    new = learned.join(last, "key", "left").filter(~F.coalesce("_open", F.lit(False)))
    made = new.select("key", (F.coalesce("_v", F.lit(0)) + 1).cast("int").alias("version"), "rules", "learned", F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("ema"), F.lit(None).cast("timestamp").alias("last_used"), F.lit(None).cast("timestamp").alias("retired"))
    return specs.unionByName(made)


def used(specs: DataFrame, uses: DataFrame, alpha: float = ordered.ALPHA) -> DataFrame:
    """``uses(key, at, seq, fill)`` of one batch, later than those before: figures of the versions in force."""
    force = current(specs).select("key", "version", "n", "ema")
    known = force.filter("n > 0").select("key", "n", "ema")
    moved = ordered.folded_average(known, uses.join(force.select("key"), "key", "left_semi"), "key", ["at", "seq"], "fill", alpha)
    moved = moved.join(uses.groupBy("key").agg(F.max("at").alias("_at")), "key", "left").join(force.select("key", "version"), "key")
    moved = moved.select("key", "version", F.col("n").alias("_n"), F.col("ema").alias("_ema"), "_at")
    out = specs.join(moved, ["key", "version"], "left")
    return out.select("key", "version", "rules", "learned", F.coalesce("_n", "n").alias("n"), F.coalesce("_ema", "ema").alias("ema"), F.greatest("last_used", "_at").alias("last_used"), "retired")


def retire(specs: DataFrame, as_of, least: float = 0.4, uses: int = 5, idle_days: int = 30) -> DataFrame:
    """Versions in force that serve badly or were long not used are retired at ``as_of``."""
    since = F.coalesce("last_used", "learned")
    bad = ((F.col("n") >= uses) & (F.col("ema") < least)) | (since < as_of - F.make_dt_interval(days=F.lit(idle_days)))
    return specs.withColumn("retired", F.when(F.col("retired").isNull() & F.coalesce(bad, F.lit(False)), as_of).otherwise(F.col("retired")))


def listing(specs: DataFrame) -> DataFrame:
    """One row for each key: versions so far, the one in force, its figures, and whether there is any."""
    force = current(specs).select("key", F.col("version").alias("in_force"), "n", "ema", "last_used")
    return specs.groupBy("key").agg(F.max("version").alias("versions"), F.count("retired").alias("retirements")).join(force, "key", "left")


def may_learn(keys: DataFrame, failures: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Keys for which learning has not failed ``most`` times."""
    spent = failures.groupBy("key").agg(F.count(F.lit(1)).alias("_f")).filter(F.col("_f") >= most)
    return keys.join(spent.select("key"), "key", "left_anti")
