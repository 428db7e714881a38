"""Sessions: settings for a local one, and letting workers import this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: int | str = "*", name: str = "weftlake") -> SparkSession:
    """A local session with the settings the engine is tested with."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Tasks for each core where rows are dealt out.
DEALT = 4


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all cores by ``key``, for steps that cost by the row: a narrow table of millions of rows is a few splits of a file."""
    return df.repartition(DEALT * df.sparkSession.sparkContext.defaultParallelism, key)


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where the driver found it.

    Workers of a local session inherit the working folder, not ``sys.path``.
    On a cluster the package is installed or sent with ``--py-files``.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark
