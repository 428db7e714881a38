"""Streams: rolling capture segments, and ordered state per key as a stateful operator."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

SEGMENT_SECONDS, MAX_SEGMENTS, MIN_BYTES = 120, 60, 4096


def segments(spark: SparkSession, folder: str, pattern: str = "*", seconds: int = SEGMENT_SECONDS, most: int | None = None) -> DataFrame:
    """A folder of numbered capture files as a stream: place, offset in seconds, bytes.

    A file's number in its name is its place; small files and those beyond the
    limit are left out.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(folder)
    place = F.regexp_extract("path", r"(\d+)\.[^./]*$", 1).try_cast("int")
    return files.filter(F.col("length") > MIN_BYTES).select(place.alias("place"), (place * seconds).alias("offset"), F.col("content")).filter((F.col("place") >= 0) & (F.col("place") < most if most else F.lit(True)))


def complete_files(listing: DataFrame) -> DataFrame:
    """``listing(place, ...)``: all but the newest, which may still be written."""
    last = listing.agg(F.max("place").alias("last"))
    return listing.join(F.broadcast(last)).filter("place < last").drop("last")


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a callback on what has arrived; the checkpoint makes restarts resume."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, stamp: str, by: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by tumbling window and key; rows later than the watermark are dropped."""
    return events.withWatermark(stamp, late).groupBy(F.window(stamp, width), by).agg(F.count(F.lit(1)).alias("n"))


DRIFT_OUT = StructType([StructField("key", StringType()), StructField("seen", LongType()), StructField("expected", DoubleType()), StructField("current", DoubleType()), StructField("alert", BooleanType())])


class DriftProcessor(StatefulProcessor):
    """Cumulative fill of one field per key, with the baseline frozen at a number of records."""

    def __init__(self, samples: int = 20, least: float = 0.5, drop: float = 0.3) -> None:
        self.samples, self.least, self.drop = samples, least, drop

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("drift", StructType([StructField("seen", LongType()), StructField("filled", LongType()), StructField("expected", DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen, filled, expected = self.state.get() if self.state.exists() else (0, 0, -1.0)
        out = []
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for full in batch["filled"]:
            seen, filled = seen + 1, filled + bool(full)
            current = filled / seen
            if seen == self.samples:
                expected = current
            if seen > self.samples:
                out.append((str(key[0]), seen, expected, current, bool(expected >= self.least and expected - current > self.drop)))
        self.state.update((seen, filled, expected))
        yield pd.DataFrame(out, columns=[f.name for f in DRIFT_OUT.fields])

    def close(self) -> None:
        pass


def drift_stream(rows: DataFrame, samples: int = 20, least: float = 0.5, drop: float = 0.3) -> DataFrame:
    """``rows(key, seq, filled)`` as a stream -> one row per record after the baseline, with its alert.

    The streaming twin of ``operators.ordered.drift_alerts``; needs the RocksDB state store.
    """
    return rows.groupBy("key").transformWithStateInPandas(DriftProcessor(samples, least, drop), outputStructType=DRIFT_OUT, outputMode="append", timeMode="none")
