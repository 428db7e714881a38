"""Whole texts as numpy arrays: words, word hashes and shingles of a batch at once.

Texts are joined into one byte buffer, so the work is a few array passes over
the bytes instead of a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text handled at once; longer single texts are taken alone.
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20_240_229)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE[_LOWER]
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_STEP = np.uint64(0xD1342543DE82EF95)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse, n of each at least."""
    for k, base in enumerate((_ODD, _ODD_INVERSE)):
        while len(_powers[k]) < n:
            p = _powers[k]
            _powers[k] = np.concatenate([p, p * (p[-1:] * base)])
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about CHUNK_BYTES each."""
    begin = total = 0
    for k, t in enumerate(texts):
        total += len(t) + 1
        if total >= CHUNK_BYTES:
            yield begin, k + 1
            begin, total = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


class Words:
    """The words of some texts: byte buffer, word starts and ends, words per text."""

    def __init__(self, texts: list[bytes]) -> None:
        self.raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        space = _SPACE[self.raw]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.start, self.text_start)  # of each text, the first word
        self.count = np.diff(self.first)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word."""
        up, down = _grown(len(self.raw) + 1)
        total = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[self.raw] * up[: len(self.raw)], out=total[1:])
        return mix64((total[self.end] - total[self.start]) * down[self.start])


def shingle_sets(texts: list[bytes], k: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles.

    A text of fewer words has its whole sequence as its only shingle, a text
    without words none.
    """
    for begin, end in chunks(texts):
        words = Words(texts[begin:end])
        h = words.hashes()
        run = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for i in range(k):
            run = run * _STEP + h[i : i + len(run)]
        run = mix64(run)
        for first, n in zip(words.first.tolist(), words.count.tolist()):
            if n >= k:
                yield np.unique(run[first : first + n - k + 1])
            elif n:
                one = np.uint64(n)
                with np.errstate(over="ignore"):
                    for x in h[first : first + n]:
                        one = one * _STEP + x
                yield mix64(np.array([one]))
            else:
                yield np.empty(0, np.uint64)
