"""MD5 of many short strings at once: the 64 steps of RFC 1321 on arrays, a lane for each string."""

from __future__ import annotations

import hashlib

import numpy as np

#: Strings hashed together: their arrays stay in a core's cache.
LANES = 16384
#: Bytes that one block holds beside the end mark and the length.
SHORT = 55

_START = tuple(np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_TURNS = np.array([7, 12, 17, 22, 5, 9, 14, 20, 4, 11, 16, 23, 6, 10, 15, 21], np.uint32)
_ORDER = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]

_PLACE, _SIZE = np.arange(64), np.arange(SHORT + 1)[:, None]
#: For each size: what stays of a block, and the end mark and the length in bits (two bytes, from the 56th).
_KEPT = np.where(_PLACE < _SIZE, 255, 0).astype(np.uint8).view("<u8")
_ADDED = (np.where(_PLACE == _SIZE, 0x80, 0) + np.where(_PLACE == 56, 8 * _SIZE % 256, 0) + np.where(_PLACE == 57, 8 * _SIZE // 256, 0)).astype(np.uint8).view("<u8")


def _halves(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the digests of ``block``: 16 words by lanes."""
    a, b, c, d = (np.full(block.shape[1], x) for x in _START)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:  # d ^ (b & (c ^ d))
            np.bitwise_xor(d, np.bitwise_and(b, np.bitwise_xor(c, d, out=f), out=f), out=f)
        elif i < 32:  # c ^ (d & (b ^ c))
            np.bitwise_xor(c, np.bitwise_and(d, np.bitwise_xor(b, c, out=f), out=f), out=f)
        elif i < 48:
            np.bitwise_xor(d, np.bitwise_xor(b, c, out=f), out=f)
        else:  # c ^ (b | ~d)
            np.bitwise_xor(c, np.bitwise_or(b, np.invert(d, out=f), out=f), out=f)
        for term in (a, _SINES[i], block[_ORDER[i]]):
            np.add(f, term, out=f)
        turn = _TURNS[4 * (i // 16) + i % 4]
        np.left_shift(f, turn, out=g)
        np.right_shift(f, np.uint32(32) - turn, out=f)
        np.add(b, np.bitwise_or(f, g, out=f), out=f)
        a, b, c, d, f = d, f, b, c, a
    return a + _START[0], b + _START[1]


def first_eight(raw: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(n, 8) bytes: the first eight of the MD5 of each ``raw[start:start + size]``; what one block does not hold is hashed singly."""
    window = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw + bytes(64), np.uint8), 64)
    out = np.empty((len(start), 2), "<u4")
    for i in range(0, len(start), LANES):
        n = np.minimum(size[i : i + LANES], SHORT)
        block = window[start[i : i + LANES]].view("<u8")
        block &= _KEPT[n]
        block |= _ADDED[n]
        out[i : i + LANES, 0], out[i : i + LANES, 1] = _halves(np.ascontiguousarray(block.view("<u4").T))
    out = out.view(np.uint8)
    for k in np.flatnonzero(size > SHORT).tolist():
        out[k] = np.frombuffer(hashlib.md5(raw[start[k] : start[k] + size[k]]).digest()[:8], np.uint8)
    return out
