"""ISO media files: exact round trips and damaged inputs."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from weftlake.llm import media


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 70_000])
def test_round_trip(n):
    payload = media.pad(bytes(i % 251 for i in range(n)))
    raw = media.mux(payload)
    (t,) = media.tracks(raw)
    assert media.read_payload(raw, t) == payload
    assert (t.codec, t.handler, t.timescale, t.duration) == ("raw ", "vide", 25, len(payload) // 64)
    offsets, sizes, sync = t.layout(len(raw))
    assert sync.tolist() == [k % 16 == 0 for k in range(t.samples)]
    assert raw[offsets[0] : offsets[0] + 64] == payload[:64] and sizes.sum() == len(payload)


def test_other_tables():
    """Variable sizes, chunks of several sizes, 64-bit offsets, no sync table, an open-ended box."""
    data = [b"a" * 3, b"bb", b"c" * 5, b"d"]
    head = media._box(b"ftyp", b"isom")
    mdat = media._box(b"mdat", b"".join(data[:2]) + b"????" + data[2] + data[3])

    def moov(at):
        stbl = media._box(b"stbl", media._full(b"stsd", struct.pack(">I", 1), media._box(b"mp4a")), media._full(b"stts", struct.pack(">5I", 2, 3, 10, 1, 4)), media._full(b"stsz", struct.pack(">2I4I", 0, 4, 3, 2, 5, 1)), media._full(b"stsc", struct.pack(">I6I", 2, 1, 2, 1, 2, 1, 1)), media._full(b"co64", struct.pack(">I3Q", 3, at, at + 9, at + 14)))
        body = media._box(b"trak", media._box(b"mdia", media._box(b"minf", stbl)))
        return struct.pack(">I4s", 0, b"moov") + body

    raw = head + mdat + moov(len(head) + 8)
    (t,) = media.tracks(raw)
    assert media.read_payload(raw, t) == b"".join(data)
    assert t.codec == "mp4a" and t.layout(len(raw))[2].all()
    assert len(media.ranges(*t.layout(len(raw))[:2])) == 2 and t.length() == 34


def test_query(spark):
    rows = [(1, "héllo"), (2, None), (3, ""), (4, "x" * 100_000), (5, "héllo"), (None, "\0a")]
    got = {r.doc_id: r for r in media.store_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        m = media.mux(p)
        assert (r.media_bytes, r.media_sha256) == (len(m), hashlib.sha256(m).hexdigest())
    assert got[1][1:] == got[5][1:]
    assert got[4].feature.startswith("codec=raw ;handler=vide;timescale=25;duration=1563;samples=1563;keyframes=")
    assert media.store_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_damaged(spark):
    from pyspark.sql import functions as F

    whole = media.mux(media.pad(b"abc"))
    rng = np.random.default_rng(2)
    rows = [whole, None, b"", b"\0\0\0\1moov", whole[:100], whole[:-1]]
    rows += [bytes(x) for x in (np.where(rng.random(len(whole)) < 0.02, rng.integers(0, 256, len(whole)), np.frombuffer(whole, np.uint8)).astype(np.uint8) for _ in range(40))]
    df = spark.createDataFrame([(x,) for x in rows], "media binary").select(media.probe(F.col("media")).alias("p"))
    got = df.collect()
    assert got[0].p.error is None and got[1].p is None and all(got[k].p.error for k in (2, 3, 4, 5))


def edited(raw, kind, at, value, fmt=">I"):
    """A file with one number in a box's body changed."""
    begin = next(a for path, a, _ in media.boxes(raw) if path[-1] == kind)
    out = bytearray(raw)
    struct.pack_into(fmt, out, begin + at, value)
    return bytes(out)


def test_counts_are_held_against_the_file():
    whole = media.mux(media.pad(b"abc" * 1000))
    assert media._probe(whole)["error"] is None
    big = 0xFFFFFFFF
    cases = [(b"stsz", 8, big), (b"stsz", 4, big), (b"stsz", 4, 0), (b"stts", 4, big), (b"stts", 8, 3), (b"stts", 4, 0), (b"stsc", 4, big), (b"stsc", 12, big), (b"stsc", 8, 2), (b"stco", 4, big), (b"stco", 8, big), (b"stss", 4, big), (b"stss", 8, 0), (b"stss", 8, big)]
    for kind, at, value in cases:
        got = media._probe(edited(whole, kind, at, value))
        assert got["error"] or (kind, at) in ((b"stsc", 12),), (kind, at, value)
    for kind in (b"stts", b"stsz", b"stsc", b"stco"):
        begin = next(a for path, a, _ in media.boxes(whole) if path[-1] == kind)
        assert media._probe(whole[: begin - 4] + b"free" + whole[begin:])["error"], kind
    assert media._probe(media._box(b"ftyp", b"isom") + media._box(b"moof", b""))["error"] == "fragments are not read"


def test_random_damage_never_raises():
    whole = media.mux(media.pad(b"some text " * 300))
    rng = np.random.default_rng(4)
    for _ in range(3000):
        out = bytearray(whole)
        for at in rng.integers(0, 700, int(rng.integers(1, 5))):
            out[at] = int(rng.choice([0, 1, 255, int(rng.integers(256))]))
        got = media._probe(bytes(out))
        assert got["error"] or sum(t["payload_bytes"] for t in got["tracks"]) <= len(out)


def test_all_tracks():
    one, two = media.mux(media.pad(b"first" * 50)), media.mux(media.pad(b"second" * 90))
    box = lambda raw, kind: next((a, b) for path, a, b in media.boxes(raw) if path[-1] == kind)
    trak = [media._box(b"trak", raw[slice(*box(raw, b"trak"))]) for raw in (one, two)]
    sound = trak[0].replace(b"vide", b"soun")

    def file(first, second):
        head = media._box(b"ftyp", b"isom")
        tracks = [sound, trak[1]]
        size = 8 + sum(map(len, tracks))
        at = [len(head) + size + 8, len(head) + size + 8 + len(first)]
        tracks = [edited(t, b"stco", 8, x) for t, x in zip(tracks, at)]
        return head + media._box(b"moov", *tracks) + media._box(b"mdat", first, second)

    first, second = media.pad(b"first" * 50), media.pad(b"second" * 90)
    got = media._probe(file(first, second))
    assert got["error"] is None and [(t["handler"], t["payload_sha256"]) for t in got["tracks"]] == [("soun", hashlib.sha256(first).hexdigest()), ("vide", hashlib.sha256(second).hexdigest())]
