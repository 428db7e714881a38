"""Near duplicates batch by batch: a stored index of fingerprint classes, probed and extended.

Under ``path`` lie ``classes`` (rep, hi, lo) and ``bands`` (table, key, rep, hi,
lo) in folders of batches, ``bands`` also by table, so a probe reads the tables
it needs and a batch appends: nothing stored is written anew.  What a batch sees
is what earlier batch numbers wrote; a batch that runs again replaces its own
folders, so a repeated one changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dedupe


def _written(spark, folder: str, schema: str, before: int) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch int").option("basePath", folder).parquet(folder).filter(F.col("batch") < before).drop("batch")


def check_and_add(prints: DataFrame, path: str, batch: int, distance: int = dedupe.MAX_DISTANCE) -> DataFrame:
    """``prints(doc_id, hi, lo)`` -> doc_id, duplicate_of, distance; the batch is in the index afterwards.

    A document's duplicate is the nearest one known before it, the smallest id
    of equally near ones: of an earlier batch, or with a smaller id in this one.
    Batches in order of ids give what one batch of all gives.  Documents without
    words take no part and come back without a duplicate.
    """
    spark = prints.sparkSession
    old = _written(spark, f"{path}/classes", "rep long, hi long, lo long", batch)
    bands = _written(spark, f"{path}/bands", "key struct<k0:bigint,k1:bigint,k2:bigint>, rep long, hi long, lo long, `table` int", batch)
    new = dedupe.fingerprint_classes(prints)
    known = dedupe.meet(new, old.withColumnRenamed("rep", "first"), ["hi", "lo"], "left")
    fresh = known.filter("first is null").select("rep", "hi", "lo")
    fresh.write.mode("overwrite").parquet(f"{path}/classes/batch={batch}")
    fresh = spark.read.schema("rep long, hi long, lo long").parquet(f"{path}/classes/batch={batch}")
    keyed = dedupe.band_keys(fresh)
    keyed.hint("rebalance", "table").write.mode("overwrite").partitionBy("table").parquet(f"{path}/bands/batch={batch}")
    apart = dedupe.distance_of("hi", "lo", "hi_b", "lo_b")
    other = bands.select("table", "key", *[F.col(c).alias(f"{c}_b") for c in ("rep", "hi", "lo")])
    before = dedupe.meet(keyed, other, ["table", "key"]).withColumn("distance", apart).filter(F.col("distance") <= distance).select("rep", F.col("rep_b").alias("to"), "distance")
    among = dedupe.near_pairs(fresh, distance).select(F.col("b").alias("rep"), F.col("a").alias("to"), "distance")
    nearest = before.unionByName(among).groupBy("rep").agg(F.min(F.struct("distance", F.col("to").alias("id"))).alias("near"))
    judged = dedupe.meet(known.select("hi", "lo", "rep", "first"), nearest, "rep", "left")
    out = dedupe.meet(prints, judged, ["hi", "lo"], "left")
    same = F.when(F.col("first").isNotNull(), F.col("first")).when(F.col("rep") < F.col("doc_id"), F.col("rep"))
    worded = (F.col("hi") != 0) | (F.col("lo") != 0)
    return out.select("doc_id", F.when(worded, F.coalesce(same, F.col("near.id"))).alias("duplicate_of"), F.when(worded, F.when(same.isNotNull(), F.lit(0)).otherwise(F.col("near.distance"))).alias("distance"))
