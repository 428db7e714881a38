"""Ordered folds over a stream: the steps of ``operators.ordered`` in event time, out of order arrivals put in order.

Rows wait in the key's state until the watermark has passed them; an event-time
timer then takes them in order through the step.  State is one value a key and
the rows that wait.  With ``idle`` a key that was quiet so many seconds loses
its state: right for steps whose state is by then that of a new key.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

_KINDS = {"long": LongType(), "double": DoubleType(), "boolean": BooleanType(), "string": StringType()}


class FoldProcessor(StatefulProcessor):
    def __init__(self, start: Callable[[], object], step: Callable, columns: list[str], out: list[str], idle: float | None) -> None:
        self.start, self.step, self.columns, self.out, self.idle = start, step, columns, out, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", StructType([StructField("json", StringType()), StructField("at", LongType())]))
        self.waiting = handle.getListState("waiting", StructType([StructField("at", LongType()), StructField("row", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for some in rows:
            at = some["at_ms"].tolist()
            self.waiting.appendList([(a, json.dumps(r)) for a, r in zip(at, some[self.columns].values.tolist())])
            for a in sorted(set(at)):
                self.handle.registerTimer(a)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        rows = list(self.waiting.get())
        due, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        text, last = self.state.get() if self.state.exists() else (None, None)
        if not due:
            if self.idle is not None and not later and last is not None and last + self.idle * 1000 <= now:
                self.state.clear()
            return iter(())
        results, state = [], json.loads(text) if text is not None else self.start()
        for row in sorted(json.loads(r[1]) for r in due):
            state, result = self.step(state, (key[0], row[1], row[0], *row[2:]))
            results.append(result)
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        last = max(r[0] for r in due)
        self.state.update((json.dumps(state), last))
        if self.idle is not None:
            self.handle.registerTimer(int(last + self.idle * 1000))
        return iter([pd.DataFrame(results, columns=self.out)])

    def close(self) -> None:
        pass


def fold_stream(rows: DataFrame, key: str, at: str, seq: str, start: Callable[[], object], step: Callable, out: str, values: list[str], late: str = "10 minutes", idle: float | None = None) -> DataFrame:
    """A stream through ``step`` in order of (``at``, ``seq``) of each key: what ``fold_sorted`` gives for the table.

    ``values`` follow key, seq and seconds in the rows that ``step`` sees.
    Rows later than the watermark are dropped.  Needs the RocksDB state store.
    """
    names = [c.split() for c in out.split(",")]
    schema = StructType([StructField(n, _KINDS[k]) for n, k in names])
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1_000_000.0
    lean = rows.withWatermark(at, late).select(F.col(key).alias("of_key"), F.col(at), F.ceil(seconds * 1000).cast("long").alias("at_ms"), seconds.alias("of_seconds"), F.col(seq).alias("of_seq"), *values)
    processor = FoldProcessor(start, step, ["of_seconds", "of_seq", *values], [n for n, _ in names], idle)
    return lean.groupBy("of_key").transformWithStateInPandas(processor, outputStructType=schema, outputMode="append", timeMode="eventTime")
