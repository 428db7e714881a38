"""Media columns in ISO base media files, read without decoding their payloads.

``mux`` stores bytes as an uncompressed 8-bit grey video: frames of 8 x 8
samples (64 bytes), every 16th a sync frame, 16 frames a chunk.  ``probe`` reads
any ISO media file: it walks the nested boxes, decodes the sample tables (stts,
stsc, stsz, stco or co64, stss) and gives codec, duration and the byte ranges of
keyframes; payloads are addressed, never decoded.

All tracks of a file are given.  Counts in a file are held against the box they
are in and the file before anything is made of their size.

Defined results: a null media value probes to null, a damaged one to a row whose
``error`` says why (bytes that hold no track, tables that disagree, samples
outside the file, a track without times, fragments, which are not read); null
text is stored as an empty one.  Columns other than the ones named pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

FRAME = 64
SYNC_EVERY = 16
FRAMES_PER_CHUNK = 16
TIMESCALE = 25
CODEC = b"raw "
#: Boxes that hold boxes.
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta")
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def pad(raw: bytes, unit: int = FRAME) -> bytes:
    """Zero bytes up to a positive multiple of ``unit``."""
    return raw + bytes(-len(raw) % unit if raw else unit)


def mux(payload: bytes) -> bytes:
    """An ISO media file of a payload of whole frames."""
    frames = len(payload) // FRAME
    chunks = -(-frames // FRAMES_PER_CHUNK)
    last = frames - (chunks - 1) * FRAMES_PER_CHUNK
    runs = [(1, FRAMES_PER_CHUNK, 1)] if chunks > 1 or last == FRAMES_PER_CHUNK else []
    if last != FRAMES_PER_CHUNK:
        runs.append((chunks, last, 1))
    sync = np.arange(1, frames + 1, SYNC_EVERY, dtype=">u4")
    entry = _box(CODEC, bytes(6), struct.pack(">H16x2H2IIH32s2H", 1, 8, 8, 0x480000, 0x480000, 0, 1, b"\0" * 32, 8, 0xFFFF))
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")

    def moov(first: int) -> bytes:
        at = first + np.arange(chunks, dtype=np.int64) * FRAMES_PER_CHUNK * FRAME
        wide = int(at[-1]) >= 1 << 32
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">3I", 1, frames, 1)),
            _full(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">3I", *r) for r in runs)),
            _full(b"stsz", struct.pack(">2I", FRAME, frames)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes()),
        )
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">4I2H", 0, 0, TIMESCALE, frames, 0x55C4, 0)),
            _full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"frames\0"),
            _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
        )
        track = _full(b"tkhd", struct.pack(">5I8x4H", 0, 0, 1, 0, frames, 0, 0, 0, 0), _MATRIX, struct.pack(">2I", 8 << 16, 8 << 16), flags=3)
        movie = _full(b"mvhd", struct.pack(">4IIH10x", 0, 0, TIMESCALE, frames, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", movie, _box(b"trak", track, media))

    lead = 16 if len(payload) + 8 >= 1 << 32 else 8
    size = len(moov(0)) if len(payload) < 1 << 31 else len(moov(1 << 33))
    return head + moov(len(head) + size + lead) + _box(b"mdat", payload)


def boxes(raw: bytes, begin: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """All boxes in file order: path, begin and end of the body; containers before what they hold."""
    end = len(raw) if end is None else end
    while begin + 8 <= end:
        size, kind = struct.unpack_from(">I4s", raw, begin)
        body = begin + 8
        if size == 1:
            if body + 8 > end:
                raise ValueError("a long box is cut off")
            size, body = struct.unpack_from(">Q", raw, body)[0], body + 8
        stop = end if size == 0 else begin + size
        if stop < body or stop > end:
            raise ValueError(f"box {kind!r} leaves its parent")
        yield (*path, kind), body, stop
        if kind in CONTAINERS:
            yield from boxes(raw, body, stop, (*path, kind))
        begin = stop


@dataclass
class Track:
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    tables: dict[bytes, np.ndarray] = field(default_factory=dict)
    fixed_size: int = 0
    samples: int = 0

    times: np.ndarray | None = None  # count and duration of runs of samples

    def layout(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offset, size and sync flag of each sample of a file of ``size`` bytes."""
        n = self.samples
        if n * max(self.fixed_size, 1) > size:
            raise ValueError("more samples than bytes")
        sizes = np.full(n, self.fixed_size, np.int64) if self.fixed_size else self.tables[b"stsz"].astype(np.int64)[:n]
        if int(sizes.sum()) > size:
            raise ValueError("samples are longer than the file")
        at, runs = self.tables.get(b"stco", np.zeros(0)).astype(np.int64), self.tables.get(b"stsc", np.zeros((0, 3))).astype(np.int64)
        spans = np.diff(np.append(runs[:, 0], len(at) + 1))
        if n and (not len(runs) or runs[0, 0] != 1 or (spans < 0).any()):
            raise ValueError("the chunk table has no beginning or goes back")
        upto_chunk = np.cumsum(np.repeat(runs[:, 1], spans))
        if n and (not len(upto_chunk) or upto_chunk[-1] < n):
            raise ValueError("fewer places than samples")
        if self.times is None or int(self.times[:, 0].sum()) != n:
            raise ValueError("times and samples differ in number")
        chunk = np.searchsorted(upto_chunk, np.arange(n), side="right")
        upto = np.cumsum(sizes) - sizes
        begins = np.flatnonzero(np.diff(chunk, prepend=-1)) if n else np.zeros(0, np.int64)
        offsets = at[chunk] + upto - np.repeat(upto[begins], np.diff(np.append(begins, n)))
        if n and (int((offsets + sizes).max()) > size or int(offsets.min()) < 0):
            raise ValueError("a sample lies outside the file")
        sync = np.ones(n, bool)
        if b"stss" in self.tables:
            keys = self.tables[b"stss"].astype(np.int64)
            if len(keys) and (keys.min() < 1 or keys.max() > n):
                raise ValueError("a sync sample that is not there")
            sync[:] = False
            sync[keys - 1] = True
        return offsets, sizes, sync

    def length(self) -> int:
        """The duration that the samples' times add up to."""
        return int((self.times[:, 0].astype(object) * self.times[:, 1].astype(object)).sum()) if self.times is not None and len(self.times) else 0


def _rows(raw: bytes, a: int, b: int, width: int, kind: str) -> np.ndarray:
    """A counted table of numbers in the box body from ``a`` to ``b``."""
    n = struct.unpack_from(">I", raw, a + 4)[0]
    if n * width * int(kind[-1]) > b - a - 8:
        raise ValueError("a table is longer than its box")
    return np.frombuffer(raw, kind, n * width, a + 8).reshape(n, width)


def tracks(raw: bytes) -> list[Track]:
    """The tracks of a file with their sample tables."""
    found: list[Track] = []
    for path, a, b in boxes(raw):
        kind, t = path[-1], found[-1] if found else Track()
        if kind == b"moof":
            raise ValueError("fragments are not read")
        if kind == b"trak":
            found.append(Track())
        elif len(path) < 3 or b"trak" not in path:
            continue
        elif kind == b"mdhd":
            t.timescale, t.duration = struct.unpack_from(">IQ", raw, a + 20) if raw[a] else struct.unpack_from(">2I", raw, a + 12)
        elif kind == b"hdlr":
            t.handler = raw[a + 8 : a + 12].decode("latin-1")
        elif kind == b"stsd":
            t.codec = raw[a + 12 : a + 16].decode("latin-1")
        elif kind == b"stsz":
            t.fixed_size, t.samples = struct.unpack_from(">2I", raw, a + 4)
            if not t.fixed_size:
                if 4 * t.samples > b - a - 12:
                    raise ValueError("a table is longer than its box")
                t.tables[kind] = np.frombuffer(raw, ">u4", t.samples, a + 12)
        elif kind == b"stts":
            t.times = _rows(raw, a, b, 2, ">u4").astype(np.int64)
        elif kind == b"stsc":
            t.tables[kind] = _rows(raw, a, b, 3, ">u4")
        elif kind in (b"stco", b"co64", b"stss"):
            t.tables[b"stco" if kind == b"co64" else kind] = _rows(raw, a, b, 1, ">u8" if kind == b"co64" else ">u4")[:, 0]
    return found


def ranges(offsets: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges in order, those that touch joined."""
    if not len(offsets):
        return []
    ends = offsets + sizes
    cut = np.flatnonzero(offsets[1:] != ends[:-1])
    return list(zip(offsets[np.concatenate([[0], cut + 1])].tolist(), ends[np.append(cut, len(ends) - 1)].tolist()))


_TRACK = StructType(
    [
        StructField("codec", StringType()),
        StructField("handler", StringType()),
        StructField("timescale", LongType()),
        StructField("duration", LongType()),
        StructField("samples", LongType()),
        StructField("keyframes", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))),
        StructField("payload_bytes", LongType()),
        StructField("payload_sha256", StringType()),
        StructField("tail_crc32", LongType()),
    ]
)
PROBE = StructType([StructField("tracks", ArrayType(_TRACK)), StructField("media_sha256", StringType()), StructField("error", StringType())])


def read_payload(raw: bytes, track: Track) -> bytes:
    """A track's bytes in sample order, through the sample tables."""
    offsets, sizes, _ = track.layout(len(raw))
    return b"".join([raw[a:b] for a, b in ranges(offsets, sizes)])


def _described(raw: bytes, track: Track) -> dict:
    offsets, sizes, sync = track.layout(len(raw))
    payload = b"".join([raw[a:b] for a, b in ranges(offsets, sizes)])
    return {
        "codec": track.codec,
        "handler": track.handler,
        "timescale": track.timescale,
        "duration": track.length(),
        "samples": track.samples,
        "keyframes": [{"start": a, "end": b} for a, b in zip(offsets[sync].tolist(), (offsets + sizes)[sync].tolist())],
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-FRAME:]),
    }


def _probe(raw: bytes | None) -> dict | None:
    if raw is None:
        return None
    found, error = None, None
    try:
        found = [_described(raw, t) for t in tracks(raw)]
        error = None if found else "no track"
    except (ValueError, IndexError, KeyError, OverflowError, RecursionError, struct.error) as why:
        error = str(why) or type(why).__name__
    return {"tracks": found, "media_sha256": hashlib.sha256(raw).hexdigest(), "error": error}


@F.pandas_udf(BinaryType())
def _mux(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: mux(pad((t or "").encode())))


@F.pandas_udf(PROBE)
def _probe_column(media: pd.Series) -> pd.DataFrame:
    rows = [_probe(x) or {} for x in media]
    return pd.DataFrame({f.name: pd.Series([r.get(f.name) for r in rows], dtype=object) for f in PROBE.fields})


def media_column(text: Column) -> Column:
    """Text as an ISO media file."""
    return _mux(F.coalesce(text, F.lit("")))


def probe(media: Column) -> Column:
    """What a media file's tables say, as a struct (see PROBE)."""
    return F.when(media.isNotNull(), _probe_column(media))


def store_texts(documents: DataFrame) -> DataFrame:
    """Texts stored as media and read back: the contract's digest."""
    rows = documents.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), media_column(F.col("text")).alias("media"))
    read = rows.select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), _probe_column("media").alias("all"))
    read = read.select("doc_id", "n_bytes", "media_bytes", "all.media_sha256", F.get("all.tracks", F.lit(0)).alias("p"))
    keys = F.array_join(F.transform("p.keyframes", lambda k: F.concat_ws("-", k["start"].cast("string"), k["end"].cast("string"))), ",")
    feature = F.format_string("codec=%s;handler=%s;timescale=%d;duration=%d;samples=%d;keyframes=%s", "p.codec", "p.handler", "p.timescale", "p.duration", "p.samples", keys)
    return read.select("doc_id", "n_bytes", "p.payload_bytes", "p.payload_sha256", "p.tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
