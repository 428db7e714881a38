"""Ordered state per key: closed forms as windows, folds over sorted partitions.

``fold_sorted`` carries a key's state from batch to batch of a sorted partition:
a key of any size is streamed, never held.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_SAMPLES, MIN_EXPECTED, DROP = 20, 0.5, 0.3
ALPHA = 0.25
#: Terms of a moving average whose weights sum to less than this are left out.
EMA_REST = 1e-18


def drift_alerts(df: DataFrame, key: str, order: list[str], filled: dict[str, Column], samples: int = MIN_SAMPLES, least: float = MIN_EXPECTED, drop: float = DROP) -> DataFrame:
    """key, field, seen, expected, current: records at which a field's cumulative fill fell too far.

    The baseline of a key is frozen at its ``samples``-th record; an alert needs
    a baseline of ``least`` and a fall of more than ``drop``.
    """
    so_far = Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(F.col(key).alias("key"), *order, *[c.cast("int").alias(f) for f, c in filled.items()])
    rows = rows.withColumn("seen", F.count(F.lit(1)).over(so_far))
    for f in filled:
        rows = rows.withColumn(f"_{f}", F.sum(f).over(so_far) / F.col("seen"))
        rows = rows.withColumn(f"_b{f}", F.max(F.when(F.col("seen") == samples, F.col(f"_{f}"))).over(so_far))
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_b{f}").alias("expected"), F.col(f"_{f}").alias("current")) for f in filled]))
    flat = rows.filter(F.col("seen") > samples).select("key", *order, "seen", fields.alias("f")).select("key", *order, "seen", "f.*")
    return flat.filter((F.col("expected") >= least) & (F.col("expected") - F.col("current") > drop))


def average_terms(alpha: float) -> int | None:
    """How many of the last values count: all that stand before them weigh less than EMA_REST together; None for all."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha: from 0 to 1")
    return None if alpha == 0 else 1 if alpha == 1 else math.ceil(math.log(EMA_REST) / math.log1p(-alpha)) + 1


def moving_average(df: DataFrame, key: str, order: list[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """key, n, ema after all records: the first sets it, later ones move it by alpha.

    A weighted sum over the last records, as many as ``alpha`` makes count; the
    numbering limits a key's rows before they are shuffled.
    """
    last, terms = Window.partitionBy(key).orderBy(*[F.col(o).desc() for o in order]), average_terms(alpha)
    total = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    near = df.withColumn("_j", F.row_number().over(last))
    near = (near if terms is None else near.filter(F.col("_j") <= terms)).select(key, "_j", value)
    weight = F.when(F.col("_j") == F.col("n"), F.lit(1.0)).otherwise(F.lit(alpha)) * F.pow(F.lit(1 - alpha), F.col("_j") - 1)
    return near.join(total, key).groupBy(key).agg(F.max("n").alias("n"), F.sum(F.col(value) * weight).alias("ema"))


def folded_average(stored: DataFrame, batch: DataFrame, key: str, order: list[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """key, n, ema of ``stored`` (key, n, ema) with the records of a later ``batch``; batches in order give what one pass gives.

    A batch of m records is a pair: what it leaves of what was there,
    ``(1 - alpha) ** m``, and what it adds; pairs of the two tables meet by key.
    """
    new = moving_average(batch, key, order, value, alpha).select(key, F.col("n").alias("_m"), F.col("ema").alias("_e"))
    first = batch.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias("_first"))
    new = new.join(first, key)
    left = F.pow(F.lit(1 - alpha), F.col("_m"))
    # alone, the batch's first record weighs as if it set the average: after others it weighs alpha of that
    moved = F.col("ema") * left + F.col("_e") - F.col("_first") * F.pow(F.lit(1 - alpha), F.col("_m") - 1) * F.lit(1 - alpha)
    both = stored.select(key, "n", "ema").join(new, key, "full")
    ema = F.when(F.col("n").isNull(), F.col("_e")).when(F.col("_m").isNull(), F.col("ema")).otherwise(moved)
    return both.select(key, (F.coalesce("n", F.lit(0)) + F.coalesce("_m", F.lit(0))).alias("n"), ema.alias("ema"))


def is_stale(uses: Column, ema: Column, idle_days: Column, retired: Column) -> Column:
    return retired | ((uses >= 5) & (ema < 0.4)) | (idle_days > 30)


def fold_sorted(df: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable, out: str, columns: list[str]) -> DataFrame:
    """Rows in order of each key through ``step(state, row) -> (state, result tuple)``.

    ``out`` is the schema of the results; ``columns`` are what ``step`` sees.
    """
    names, kinds = zip(*(c.split() for c in out.split(",")))
    arrow = [{"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}[k] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = start, None  # no key equals the start function; a null key is one key
        for b in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != current:
                    current, state = row[0], start()
                state, result = step(state, row)
                rows.append(result)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow)], names=list(names))

    lean = df.select(key, *columns)
    return lean.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, out)


def breaker_step(threshold: int = 8, recover: float = 300.0, successes: int = 2) -> Callable:
    """The circuit of one host: rows (host, seq, seconds, failed) -> host, seq, state after the row."""

    def step(state, row):
        mode, count, opened = state
        host, seq, now, failed = row
        if mode == "open" and now - opened >= recover:
            mode, count = "half_open", 0
        if failed:
            count = count + 1 if mode == "closed" else 0
            if mode == "half_open" or (mode == "closed" and count >= threshold):
                mode, count, opened = "open", 0, now
        elif mode == "half_open":
            count += 1
            if count >= successes:
                mode, count = "closed", 0
        elif mode == "closed":
            count = 0
        return (mode, count, opened), (host, seq, mode)

    return step


def breaker_states(df: DataFrame, key: str, seq: str, seconds: Column, failed: Column, threshold: int = 8, recover: float = 300.0, successes: int = 2) -> DataFrame:
    """host, seq, state of each record's circuit after it."""
    rows = df.select(F.col(key).alias("host"), F.col(seq).alias("seq"), seconds.cast("double").alias("seconds"), failed.alias("failed"))
    return fold_sorted(rows, "host", ["seconds", "seq"], lambda: ("closed", 0, 0.0), breaker_step(threshold, recover, successes), "host long, seq long, state string", ["seq", "seconds", "failed"])


def bucket_step(rate: float, burst: float) -> Callable:
    """A token bucket: rows (host, seq, seconds) -> host, seq, allowed, tokens left."""

    def step(state, row):
        tokens, last = state
        host, seq, now = row
        tokens = min(burst, tokens + (0 if last is None else max(0.0, now - last) * rate))
        allowed = tokens >= 1
        return (tokens - allowed, now), (host, seq, bool(allowed), float(tokens - allowed))

    return step


def token_bucket(df: DataFrame, key: str, seq: str, seconds: Column, rate: float, burst: float) -> DataFrame:
    rows = df.select(F.col(key).alias("host"), F.col(seq).alias("seq"), seconds.cast("double").alias("seconds"))
    return fold_sorted(rows, "host", ["seconds", "seq"], lambda: (burst, None), bucket_step(rate, burst), "host long, seq long, allowed boolean, tokens double", ["seq", "seconds"])


def limiter_step(rate: float, burst: float, slots: int, gap: float) -> Callable:
    """A host's limiter: rows (host, seq, seconds, length) -> host, seq, when the request starts and how long it waited.

    A request takes the slot that is free first, then a token, then keeps
    ``gap`` from the last end; it holds its slot for its length.
    """

    def step(state, row):
        free, tokens, filled, last = state
        host, seq, now, length = row
        ends = [*free, *([] if last is None else [last])]
        free = list(free)
        start = max(now, heapq.heappop(free)) if len(free) >= slots else now
        tokens, filled = min(burst, tokens + (0 if filled is None else max(0.0, start - filled) * rate)), start if filled is None else max(filled, start)
        if tokens < 1:
            start = filled + (1 - tokens) / rate
            tokens, filled = 1.0, start
        ended = max([e for e in ends if e <= start], default=None)
        start = start if ended is None else max(start, ended + gap)
        heapq.heappush(free, start + length)
        return (free, tokens - 1, filled, ended), (host, seq, float(start), float(start - now))

    return step


LIMITED = "host long, seq long, start double, waited double"


def limited(df: DataFrame, key: str, seq: str, seconds: Column, length: Column, rate: float, burst: float, slots: int, gap: float) -> DataFrame:
    """host, seq, start, waited of each request under its host's slots, tokens and gap, in order of arrival."""
    rows = df.select(F.col(key).alias("host"), F.col(seq).alias("seq"), seconds.cast("double").alias("seconds"), length.cast("double").alias("length"))
    return fold_sorted(rows, "host", ["seconds", "seq"], lambda: ([], burst, None, None), limiter_step(rate, burst, slots, gap), LIMITED, ["seq", "seconds", "length"])


def retry_after(value: Column, as_of: Column) -> Column:
    """Seconds to wait that a server asks for, 3600 at most; null if unreadable."""
    wait = F.coalesce(F.trim(value).try_cast("double"), (F.unix_micros(F.try_to_timestamp(F.regexp_replace(F.trim(value), r"^[A-Za-z]{3}, ", ""), F.lit("d MMM y H:m:s 'GMT'"))) - F.unix_micros(as_of)) / 1_000_000)
    return F.when(wait.isNotNull(), F.least(F.greatest(wait, F.lit(0.0)), F.lit(3600.0)))
