"""Recorded captures as a data source: ``spark.read.format("captures").load(folder)``, offline.

A folder holds numbered recordings, ``seq=<n>/host=<name>/*.parquet``, written
by ``record``.  A read has one partition for each host of each recording and
plans only those that filters on ``host`` and ``seq`` leave; a stream reads the
recordings in order of their numbers, which are its offsets.  Any file system
that Arrow can open will do.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "seq long, host string, url string, status int, body string"
_INSIDE = ("url", "status", "body")
#: Captures in a batch: all that a worker holds of a host's recording.
BATCH = 256


def record(captures: DataFrame, folder: str, seq: int) -> None:
    """Write ``captures(host, url, status, body)`` as one recording; the same number again replaces it."""
    named = captures.select(F.coalesce("host", F.lit("")).alias("host"), F.col("url").cast("string").alias("url"), F.col("status").cast("int").alias("status"), F.col("body").cast("string").alias("body"))
    named.hint("rebalance", "host").write.mode("overwrite").partitionBy("host").parquet(f"{folder}/seq={seq}")


class Part(InputPartition):
    def __init__(self, seq: int, host: str, path: str) -> None:
        self.seq, self.host, self.path = seq, host, path


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _listed(folder: str) -> list[Part]:
    system, root = _opened(folder)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    parts: dict[tuple[int, str], Part] = {}
    for f in found:
        names = dict(x.split("=", 1) for x in f.path.removeprefix(root).strip("/").split("/") if "=" in x)
        if f.type == fs.FileType.File and f.path.endswith(".parquet") and {"seq", "host"} <= set(names):
            host = unquote(names["host"])
            host = "" if host == "__HIVE_DEFAULT_PARTITION__" else host
            parts[int(names["seq"]), host] = Part(int(names["seq"]), host, f.path.rsplit("/", 1)[0])
    return [parts[k] for k in sorted(parts)]


def _rows(folder: str, part: Part | None) -> Iterator[pa.RecordBatch]:
    if part is None:  # a read without partitions
        return
    system, _ = _opened(folder)
    for f in system.get_file_info(fs.FileSelector(part.path)):
        if f.path.endswith(".parquet"):
            with system.open_input_file(f.path) as source:
                for b in pq.ParquetFile(source, pre_buffer=False).iter_batches(BATCH, columns=list(_INSIDE)):
                    yield pa.RecordBatch.from_arrays([pa.array([part.seq] * b.num_rows, pa.int64()), pa.array([part.host] * b.num_rows), *(b.column(c) for c in _INSIDE)], names=["seq", "host", *_INSIDE])


_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


class CaptureReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder, self.tests = folder, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Filters on the folders' names are done here, the others are given back."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in ("host", "seq") and type(f) in _TESTS:
                self.tests.append((name, _TESTS[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Part]:
        return [p for p in _listed(self.folder) if all(test(getattr(p, name), value) for name, test, value in self.tests)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _rows(self.folder, partition)


class CaptureStream(DataSourceStreamReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def initialOffset(self) -> dict:  # noqa: N802
        return {"seq": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"seq": max((p.seq for p in _listed(self.folder)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [p for p in _listed(self.folder) if start["seq"] < p.seq <= end["seq"]]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _rows(self.folder, partition)

    def commit(self, end: dict) -> None:
        pass


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options["path"])

    def streamReader(self, schema) -> CaptureStream:  # noqa: N802
        return CaptureStream(self.options["path"])


def register(spark: SparkSession) -> None:
    """Let a session read captures, with filters pushed to the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)
