"""Packing documents into sequences by minimum bin slack.

A document's ids (with the end id) longer than a sequence are cut into full
pieces behind a shorter first one.  Where a piece goes depends only on its
length, so the plan is made from the histogram of lengths, at most one number
per length: the longest length left opens a bin, a subset-sum over bitsets finds
the fullest combination of the lengths left for the rest of it, and that bin is
repeated as often as the counts allow.  Pieces of a length are then numbered
(in hashed parts, so that a length with a third of all pieces is not one task's)
and number k takes the k-th place the plan has for that length.

Defined results: null and empty texts are a piece of the end id alone; repeated
rows are packed each; a null doc_id is packed like others; an empty table gives
an empty result.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import materialize
from .sharding import with_slots

CAPACITY = 1024
END_ID = 2
#: Plans with mixed orders, of either kind.
TRIES = 4


def fullest(room: int, counts: dict[int, int], lengths: list[int]) -> dict[int, int]:
    """Length -> how many, the sum at most ``room`` and as large as it can be.

    ``lengths``: those left, in the order in which sums are built; those that come
    first are used before others.  Bit s of ``reach`` says that a sum
    s can be made; multiples of a length are added by doubling.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n in lengths:
        if n > room:
            continue
        left, many = min(counts[n], room // n), 1
        while left:
            use = min(many, left)
            steps.append((n, use, reach))
            reach |= (reach << (n * use)) & mask
            left -= use
            many *= 2
            if reach >> room:
                break
        if reach >> room:
            break
    at, found = reach.bit_length() - 1, {}
    for n, use, before in reversed(steps):
        if not before >> at & 1:
            at -= n * use
            found[n] = found.get(n, 0) + use
    return found


def _filled(counts: dict[int, int], capacity: int, pinned: bool, order: Callable[[list[int]], list[int]]) -> list[tuple[dict[int, int], int]]:
    """One plan: ``pinned`` bins hold the longest length left; sums are built in ``order`` of the lengths."""
    left, out = {n: c for n, c in counts.items() if c}, []
    lengths = sorted(left, reverse=True)
    while lengths:
        if pinned:
            top = lengths[0]
            left[top] -= 1
            rest = fullest(capacity - top, left, order([n for n in lengths if left[n]]))
            left[top] += 1
            rest[top] = rest.get(top, 0) + 1
        else:
            rest = fullest(capacity, left, order(lengths))
        times = min(left[n] // k for n, k in rest.items())
        out.append((rest, times))
        for n, k in rest.items():
            left[n] -= k * times
        lengths = [n for n in lengths if left[n]]
    return out


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY, tries: int = TRIES) -> list[tuple[dict[int, int], int]]:
    """Bins as (length -> how many, times), in the order in which they are filled.

    Of equally full combinations the order of the lengths decides which is
    taken, and with it what is left for the last bins: a few plans are made and
    the shortest is kept, the first that wastes no bin at once.
    """
    rng = np.random.default_rng(17)
    mixed = lambda lengths: [lengths[k] for k in rng.permutation(len(lengths))]
    ways = [(True, list), (True, lambda x: x[::-1]), (False, lambda x: x[::-1]), *[(False, mixed)] * tries, *[(True, mixed)] * tries]
    least = -(-sum(n * c for n, c in counts.items()) // capacity)
    best, size = [], None
    for pinned, order in ways:
        plan = _filled(counts, capacity, pinned, order)
        bins = sum(times for _, times in plan)
        if size is None or bins < size:
            best, size = plan, bins
        if size <= least:
            break
    return best


def places(bins: list[tuple[dict[int, int], int]], capacity: int = CAPACITY) -> pd.DataFrame:
    """Of each length, runs of piece numbers: where they begin, sequence, how many in a bin, first offset."""
    rows, base, used = [], 0, {}
    for bin_, times in bins:
        offset = 0
        for n in sorted(bin_, reverse=True):
            rows.append((n, used.get(n, 0), base, bin_[n], offset))
            used[n] = used.get(n, 0) + bin_[n] * times
            offset += n * bin_[n]
        base += times
    return pd.DataFrame(rows, columns=["length", "begin", "base", "many", "offset"]).sort_values(["length", "begin"], ignore_index=True)


def cut_pieces(documents: DataFrame, vocabulary: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, last = tokens.encoder(vocabulary), np.array([end_id], np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), e.batch(texts)):
                    ids = np.concatenate([ids, last]).astype("<u4")
                    edge = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    raw = ids.tobytes()
                    rows += [(doc, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edge, edge[1:]))]
                doc, piece, start, length, crc = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(documents: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    pieces = materialize(cut_pieces(documents, vocabulary or tokens.vocabulary_path(), end_id, capacity), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = places(plan_bins(counts, capacity), capacity)
    key = plan["length"].to_numpy() * (1 << 40) + plan["begin"].to_numpy()

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            run = np.searchsorted(key, b["length"].to_numpy() * (1 << 40) + b["slot"].to_numpy(), side="right") - 1
            p = plan.iloc[run]
            k = b["slot"].to_numpy() - p["begin"].to_numpy()
            many = p["many"].to_numpy()
            yield b.assign(sequence_id=p["base"].to_numpy() + k // many, offset=p["offset"].to_numpy() + (k % many) * b["length"].to_numpy()).drop(columns="slot")

    numbered = with_slots(pieces, "length", ["doc_id", "piece", "ids_crc32"], parts=256)
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "slot").mapInPandas(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
