"""Token files and packing against plain tokenisation and brute force."""

import struct
import zlib
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftlake.llm import huffman, packing, tokens

ROWS = [(5, "Hello there, wörld"), (2, None), (9, ""), (3, "x y z " * 3000), (4, "x y z " * 3000), (7, "tab\t\n two  spaces 漢字"), (1, "w " * 1022), (None, "no id"), (8, "a b c"), (8, "a b c")]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(tokens.vocabulary_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def huffman_cost(counts):
    import heapq

    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    return cost


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=2, max_size=60))
def test_code_lengths(counts):
    c = np.array(counts)
    n = huffman.code_lengths(c)
    used = n[c > 0].astype(float)
    assert ((n > 0) == (c > 0)).all() and (2.0**-used).sum() <= 1
    if (c > 0).sum() > 1 and n.max() < huffman.MAX_BITS:
        assert int((n * c).sum()) == huffman_cost(c[c > 0].tolist())
    tight = huffman.code_lengths(c, 6)
    assert tight.max() <= 6 and (2.0 ** -tight[c > 0].astype(float)).sum() <= 1


def test_limited_to_sixteen_bits():
    n = huffman.code_lengths(np.array([1, 1] + [2**k for k in range(1, 40)]))
    assert n.max() == 16 and (2.0 ** -n.astype(float)).sum() == 1
    assert huffman.code_lengths(np.array([0, 7])).tolist() == [0, 1]


def test_round_trip_of_blocks():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 63, 64, 65, 1024, 1025, 5000, 2])
    ids = (rng.zipf(1.3, sizes.sum()) % 50_000).astype(np.uint32)
    code = huffman.Code(huffman.code_lengths(np.bincount(ids)))
    raw, doc_bytes, marks, _ = code.encode(ids, sizes)
    assert (code.decode(raw, doc_bytes, marks, sizes) == ids).all()


def test_more_ids_than_sixteen_bits():
    """A vocabulary of 4-byte ids with more of them in use than 2**16."""
    rng = np.random.default_rng(5)
    ids = np.concatenate([np.arange(70_000), rng.integers(0, 70_000, 30_000) ** 2 % 70_000]).astype(np.uint32)
    code = huffman.Code(huffman.code_lengths(np.bincount(ids)))
    sizes = np.array([1, 65, 99_934])
    raw, doc_bytes, marks, _ = code.encode(ids, sizes)
    assert code.bits == 17 and (code.decode(raw, doc_bytes, marks, sizes) == ids).all()
    code = huffman.Code(huffman.code_lengths(np.bincount(ids), 20))
    raw, doc_bytes, marks, _ = code.encode(ids, sizes)
    assert (code.decode(raw, doc_bytes, marks, sizes) == ids).all()


def test_token_files(spark, plain):
    df = spark.createDataFrame([(i, t, "clash") for i, t in ROWS], "doc_id long, text string, start string").repartition(3)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in huffman.token_files(df).collect()), key=lambda r: r[1])
    want, at = [], 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*plain(t), 0]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    assert huffman.token_files(df.limit(0)).count() == 0


def test_packing(spark, plain):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    rows = packing.pack(df).collect()
    want = []
    for i, t in ROWS:
        ids = [*plain(t), 2]
        edge = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(edge, edge[1:]))]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and sum(n for _, n in x) <= 1024
    total = sum(r.length for r in rows)
    assert len(by) == -(-total // 1024)
    assert packing.pack(df.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40), st.lists(st.integers(1, 20), max_size=9))
def test_fullest_is_the_best_subset(room, items):
    counts = {n: items.count(n) for n in items}
    best = max(sum(x) for k in range(len(items) + 1) for x in combinations(items, k) if sum(x) <= room)
    got = packing.fullest(room, counts, sorted(counts, reverse=True))
    assert sum(n * k for n, k in got.items()) == best and all(k <= counts[n] for n, k in got.items())


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_places_every_piece(counts):
    bins = packing.plan_bins(counts, 64)
    used = {}
    for b, times in bins:
        assert sum(n * k for n, k in b.items()) <= 64
        for n, k in b.items():
            used[n] = used.get(n, 0) + k * times
    assert used == counts
