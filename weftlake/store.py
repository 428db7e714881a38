"""Stored frames between rounds of an iteration, on the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    A local session without it, where driver and tasks share a disk, gets a
    temporary folder; on a cluster that would lose rows, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="weftlake-")
    return _local[app]


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: short lineage, no cache to lose."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
