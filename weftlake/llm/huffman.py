"""Token ids as files: canonical length-limited Huffman codes from global counts.

Documents are encoded to ids once and stored; the ids' counts, one row per
vocabulary entry, give code lengths of at most ``MAX_BITS`` (package-merge; more
only where a larger vocabulary has more than 2**MAX_BITS ids in use);
codes are canonical, so the lengths alone define them.  A document's ids are
written in byte-aligned blocks of ``BLOCK`` ids; within a block the bit offset
of every ``STEP``-th id is kept, so reading may begin at any of these, and many
places are read at once with one table look-up for each id.

Files hold one row per document in ascending doc_id order: ranges of doc_id
(from quantiles) name the folders, and rows are sorted within them.

Defined results: null and empty texts have the end id alone; a null doc_id
sorts first; rows that share a doc_id follow each other; an empty table gives
no file and an empty result.  Other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import materialize, scratch_dir

MAX_BITS = 16
BLOCK = 1024
STEP = 64
#: Ids encoded or decoded at once.
BATCH_IDS = 1 << 19


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    limit = limit or max(MAX_BITS, (len(used) - 1).bit_length())
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of this length")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    level, leaves = weight, [np.ones(len(weight), bool)]
    for _ in range(limit - 1):
        pairs = level[0 : len(level) - 1 : 2] + level[1::2]
        both = np.concatenate([weight, pairs])
        sort = np.argsort(both, kind="stable")
        level = both[sort]
        leaves.append(sort < len(weight))
    bits, take = np.zeros(len(order), np.uint8), 2 * len(order) - 2
    for leaf in reversed(leaves):
        n = int(leaf[:take].sum())
        bits[:n] += 1
        take = 2 * (take - n)
    out[order] = bits
    return out


@dataclass
class Code:
    """Canonical codes: of ids ordered by (length, id), each is its predecessor's plus one."""

    lengths: np.ndarray

    def __post_init__(self) -> None:
        used = np.flatnonzero(self.lengths)
        order = used[np.argsort(self.lengths[used], kind="stable")]
        n = self.lengths[order].astype(np.int64)
        self.bits = bits = max(MAX_BITS, int(n.max()) if len(n) else 0)
        if bits > 25:
            raise ValueError("codes are longer than four bytes can hold at any bit")
        span = np.int64(1) << (bits - n)  # of the table, a code's share
        ends = np.cumsum(span)
        self.codes = np.zeros(len(self.lengths), np.int64)
        self.codes[order] = (ends - span) >> (bits - n)
        self.symbol = np.zeros(1 << bits, np.uint32)
        self.width = np.ones(1 << bits, np.uint8)
        total = int(ends[-1]) if len(ends) else 0
        self.symbol[:total], self.width[:total] = np.repeat(order, span), np.repeat(n, span)

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents' ids, joined -> bytes, bytes of each, bit offsets, offsets of each.

        Offsets: of every STEP-th id, in bits from the document's first byte.
        """
        n = self.lengths[ids].astype(np.int64)
        first = np.cumsum(sizes) - sizes
        place = np.arange(len(ids)) - np.repeat(first, sizes)
        begin = np.flatnonzero(place % BLOCK == 0)  # of blocks
        block_bytes = (np.add.reduceat(n, begin) + 7) >> 3
        block_at = np.cumsum(block_bytes) - block_bytes
        upto = np.cumsum(n) - n
        block_of = np.cumsum(place % BLOCK == 0) - 1
        bit = upto - upto[begin][block_of] + 8 * block_at[block_of]
        span = 3 if self.bits <= 17 else 4  # bytes that a code can touch
        word = self.codes[ids] << (8 * span - n - (bit & 7))
        byte, size = bit >> 3, int(block_bytes.sum()) + span
        out = sum(np.bincount(byte + k, (word >> (8 * (span - 1 - k))) & 255, size) for k in range(span)).astype(np.uint8)[: size - span]
        blocks = -(-sizes // BLOCK)
        ends = np.cumsum(blocks)
        doc_bytes = np.add.reduceat(block_bytes, ends - blocks)
        doc_at = np.cumsum(doc_bytes) - doc_bytes
        mark = np.flatnonzero(place % STEP == 0)
        marks = -(-sizes // STEP)
        return out, doc_bytes, (bit[mark] - 8 * np.repeat(doc_at, marks)).astype(np.uint32), marks

    def decode(self, raw: np.ndarray, doc_bytes: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of documents, joined; all STEP-id runs are read side by side."""
        marks = -(-sizes // STEP)
        doc_at = np.cumsum(doc_bytes) - doc_bytes
        bit = offsets.astype(np.int64) + 8 * np.repeat(doc_at, marks)
        place = np.arange(len(bit)) - np.repeat(np.cumsum(marks) - marks, marks)
        left = np.minimum(STEP, np.repeat(sizes, marks) - STEP * place)
        to = np.repeat(np.cumsum(sizes) - sizes, marks) + STEP * place
        order = np.argsort(-left, kind="stable")
        bit, to, left = bit[order], to[order], left[order]
        span = 3 if self.bits <= 17 else 4
        near = np.concatenate([raw, np.zeros(span, np.uint8)]).astype(np.uint32)
        wide = sum(near[k : len(near) - span + k] << np.uint32(8 * (span - 1 - k)) for k in range(span)).astype(np.uint32)
        mask = np.uint32((1 << self.bits) - 1)
        out = np.empty(int(sizes.sum()), np.uint32)
        live = np.searchsorted(-left, -np.arange(STEP), side="left")  # runs with more than k ids
        for k in range(STEP):
            m = int(live[k])
            if not m:
                break
            at = bit[:m]
            look = (wide[at >> 3] >> (8 * span - self.bits - (at & 7)).astype(np.uint32)) & mask
            out[to[:m] + k] = self.symbol[look]
            at += self.width[look]
        return out


def _groups(sizes: list[int], most: int = BATCH_IDS) -> Iterator[tuple[int, int]]:
    begin = total = 0
    for k, n in enumerate(sizes):
        total += n
        if total >= most:
            yield begin, k + 1
            begin, total = k + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def encode_texts(documents: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, ids: the texts' ids and the end id as little-endian numbers of 2 bytes (4 for large vocabularies)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = tokens.encoder(path)
        last = np.array([end_id], e.flat.dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                ids = [x.tobytes() + last for x in e.batch(texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")


def count_ids(encoded: DataFrame, width: int) -> np.ndarray:
    """How often each id occurs; one row per id and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                found = np.bincount(np.frombuffer(b"".join(batch.column(0).slice(at, 1000).to_pylist()), f"<u{width}"))
                if len(found) > len(total):
                    found, total = total, found
                total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # at most the vocabulary
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, np.int64)
    counts[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return counts


def doc_ranges(ids: DataFrame, ranges: int) -> list[int]:
    """Bounds that deal doc_ids to ranges of about equal size."""
    bounds = ids.select(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 else []
    return sorted(set(bounds or []))


def write_files(encoded: DataFrame, code: Code, width: int, bounds: list[int], path: str) -> None:
    """Rows doc_id, n_ids, payload, offsets; folders by range of doc_id, sorted within."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(1)
            for a, b in _groups((np.diff(np.frombuffer(every.buffers()[1], np.int32, len(every) + 1, 4 * every.offset)) // width).tolist()):
                raw = every.slice(a, b - a).to_pylist()
                sizes = np.array([len(x) // width for x in raw])
                out, doc_bytes, marks, n_marks = code.encode(np.frombuffer(b"".join(raw), f"<u{width}"), sizes)
                cut = lambda x, ends: [x[i:j].tobytes() for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(cut(out, np.cumsum(doc_bytes)), pa.binary()), pa.array(cut(marks.astype("<u4"), np.cumsum(n_marks)), pa.binary())],
                    names=["doc_id", "n_ids", "payload", "offsets"],
                )

    rows = encoded.mapInArrow(run, "doc_id long, n_ids long, payload binary, offsets binary")
    steps = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    rows = rows.withColumn("range", F.coalesce(F.size(F.filter(steps, lambda b: b <= F.col("doc_id"))), F.lit(0)))
    rows.repartition("range").sortWithinPartitions("range", "doc_id").write.partitionBy("range").option("compression", "none").parquet(path)


def read_files(spark: SparkSession, path: str, code: Code, end_id: int) -> DataFrame:
    """Per document: doc_id, range, n_tokens and the checksum of its decoded ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column(2).to_numpy()
            for a, b in _groups(counts.tolist()):
                part, sizes = batch.slice(a, b - a), counts[a:b]
                raw, marks = part.column(3).to_pylist(), part.column(4).to_pylist()
                ids = code.decode(np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw]), np.frombuffer(b"".join(marks), "<u4"), sizes)
                ends = np.cumsum(sizes)
                sums = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip((ends - sizes).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(sums, pa.int64())], names=["doc_id", "range", "n_tokens", "ids_crc32"])

    rows = spark.read.schema("doc_id long, n_ids long, payload binary, offsets binary, range int").parquet(path)
    return rows.select("doc_id", "range", "n_ids", "payload", "offsets").mapInArrow(run, "doc_id long, range int, n_tokens long, ids_crc32 long")


def with_starts(rows: DataFrame) -> DataFrame:
    """Add start: the ids of all documents before, by sums of ranges and within them."""
    totals = rows.groupBy("range").agg(F.sum("n_tokens").alias("_n"))  # one row per range, a bounded number
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("range").orderBy("doc_id", "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return inside.join(F.broadcast(base), "range").withColumn("start", F.col("_base") + F.col("_before")).select("doc_id", "start", "n_tokens", "ids_crc32")


def token_files(documents: DataFrame, vocabulary: str | None = None, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write a documents table's ids to files and read them back."""
    spark, vocabulary = documents.sparkSession, vocabulary or tokens.vocabulary_path()
    path = path or f"{scratch_dir(spark)}/weftlake/{uuid.uuid4().hex}/ids"
    width = 2 if tokens.encoder(vocabulary).size <= 1 << 16 else 4
    encoded = materialize(encode_texts(documents, vocabulary, end_id), "encoded")
    code = Code(code_lengths(count_ids(encoded, width)))
    ranges = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    write_files(encoded, code, width, doc_ranges(encoded, ranges), path)
    return with_starts(materialize(read_files(spark, path, code, end_id), "read"))
