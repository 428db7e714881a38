"""Shared helpers: scratch tables on the cluster's shared folder, and loading."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reachable
from ..store import shared_dir


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir`` (see ``store.shared_dir``)."""
    return shared_dir(spark)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation, and
    tasks that run twice leave one copy of their rows.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/weftlake/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tasks that share the rows of one key in ``salted_join``.
SALTS = 16


def meet(one: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by shuffles alone, for tables that grow with the input.

    Spark estimates a stored table by its compressed bytes and leaves out how
    often a row is repeated: it takes millions of narrow rows for a small table,
    and a broadcast would bring them all to the driver.
    """
    return one.join(other.hint("merge"), on, how)


def salted_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner", salt: str | None = None, grows: bool = False) -> DataFrame:
    """``many`` joined with ``one`` (one row of each key) on ``key``, rows of a frequent key spread over SALTS tasks.

    ``one`` is repeated SALTS times; ``many`` is dealt by a hash of ``salt``, or of all its columns.
    ``grows``: ``one`` grows with the input, so that the join is by shuffles (``meet``) and not as Spark's estimate has it.
    """
    deal = F.pmod(F.xxhash64(*([salt] if salt else many.columns)), F.lit(SALTS)).cast("int")
    copies = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    many = many.withColumn("_salt", deal)
    return (meet if grows else DataFrame.join)(many, copies, [key, "_salt"], how).drop("_salt")


#: Rows of one key that ``spread_join`` leaves to one task.
HOT = 4096


def spread_join(many: DataFrame, one: DataFrame, key: str, salt: str) -> DataFrame:
    """``many``, a stored table, joined with ``one`` (one row of each key): only the rows of ``one`` whose key is frequent are repeated.

    For wide rows in ``one``: a key with more than HOT rows is dealt by a hash of
    ``salt`` to as many tasks as it needs, all other rows travel once.
    """
    hot = many.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT)
    hot = materialize(hot.select(key, F.ceil(F.col("_n") / HOT).cast("int").alias("_tasks")), "hot")  # one for each HOT rows at most
    if not hot.limit(1).count():
        return many.join(one, key)
    dealt = salted_join(many, hot, key, "left", salt).withColumn("_at", F.pmod(F.xxhash64(salt), F.coalesce("_tasks", F.lit(1))).cast("int")).drop("_tasks")
    copies = one.join(hot, key, "left").withColumn("_at", F.explode(F.sequence(F.lit(0), F.coalesce("_tasks", F.lit(1)) - 1))).drop("_tasks")
    return dealt.join(copies, [key, "_at"]).drop("_at")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Words are maximal runs of bytes other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
