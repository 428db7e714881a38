"""Upserts from a stream that a repeated batch does not change.

A table is a ledger and data folders: an entry of the ledger names, for every
bucket of keys, the folder that holds it, and the last batch that is in it.  A
batch rewrites the buckets it touches into a folder of its own and becomes
visible with its entry, which one rename puts in place.  A run that ends before
that leaves a folder that no entry names; a batch whose entry is there is not
applied again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables

BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


def latest(spark: SparkSession, path: str) -> dict | None:
    """The newest entry: batch, buckets (bucket -> folder), schema."""
    fs, at = _fs(spark, path)
    ledger = at(f"{path}/_ledger")
    names = sorted(f.getPath().getName() for f in fs.listStatus(ledger)) if fs.exists(ledger) else []
    names = [n for n in names if n.endswith(".json")]
    if not names:
        return None
    return json.loads(spark.read.text(f"{path}/_ledger/{names[-1]}", wholetext=True).first()[0])


def _enter(spark: SparkSession, path: str, entry: dict) -> None:
    fs, at = _fs(spark, path)
    name = f"{path}/_ledger/{entry['batch']:020d}.json"
    out = fs.create(at(f"{name}.{uuid.uuid4().hex}.new"), True)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    written = next(f.getPath() for f in fs.listStatus(at(f"{path}/_ledger")) if f.getPath().getName().startswith(f"{entry['batch']:020d}.json.") and f.getPath().getName().endswith(".new"))
    if not fs.rename(written, at(name)):
        raise OSError(f"{name} is there already: another run has applied this batch")


def table(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the newest entry; none before the first batch."""
    entry = latest(spark, path)
    if entry is None:
        return None
    schema = spark._jvm.org.apache.spark.sql.types.DataType.fromJson(entry["schema"]).toDDL()
    folders = [f"{path}/data/{folder}/bucket={k}" for k, folder in sorted(entry["buckets"].items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert_batch(new: DataFrame, batch: int, path: str, keys: Sequence[str], order: Sequence[str], buckets: int = BUCKETS) -> bool:
    """Apply a batch once: the latest row of each key by ``order``. False where the ledger has it already."""
    spark = new.sparkSession
    entry = latest(spark, path) or {"batch": -1, "buckets": {}, "count": buckets, "schema": new.schema.json()}
    if batch <= entry["batch"]:
        return False
    bucket = F.pmod(F.xxhash64(*keys), F.lit(entry["count"])).cast("int")
    touched = [r[0] for r in new.select(bucket).distinct().collect()]  # as many as there are buckets at most
    there = [f"{path}/data/{entry['buckets'][str(k)]}/bucket={k}" for k in touched if str(k) in entry["buckets"]]
    rows = new.select(*new.columns)
    if there:
        rows = spark.read.schema(new.schema).parquet(*there).unionByName(rows)
    folder = f"{batch:020d}-{uuid.uuid4().hex}"
    kept = tables.upsert(rows, keys, order).select(*new.columns)
    kept.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{path}/data/{folder}")
    _enter(spark, path, entry | {"batch": batch, "buckets": entry["buckets"] | {str(k): folder for k in touched}})
    return True


def sink(path: str, keys: Sequence[str], order: Sequence[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``."""

    def apply(batch: DataFrame, number: int) -> None:
        upsert_batch(batch, number, path, keys, order, buckets)

    return apply


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove folders that the newest entry does not name; how many there were."""
    fs, at = _fs(spark, path)
    entry, data = latest(spark, path), at(f"{path}/data")
    if entry is None or not fs.exists(data):
        return 0
    gone = [f.getPath() for f in fs.listStatus(data) if f.getPath().getName() not in set(entry["buckets"].values())]
    for p in gone:
        fs.delete(p, True)
    return len(gone)
