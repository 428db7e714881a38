"""Token ids of whole texts with a public tokenizer file, each piece encoded once.

Byte-level BPE with the usual word pattern never joins a character that is not
white space with white space after it, nor a letter with a following character
that is neither letter nor space.  A text is cut at such places (those that can
be told from ASCII and Latin-1 letters; elsewhere it stays whole), each distinct
piece is encoded once per worker and remembered, and a text's ids are its
pieces' ids.  New pieces are encoded joined into long strings, whose ids are
told apart by their lengths in bytes.

Strings of added tokens in a text (``<|endoftext|>``) are what the library takes
them for, one id each: a text is cut around them first.  ``added=False`` reads
them as ordinary text instead.

Remembered pieces are found by a 64-bit hash and compared byte by byte; a chunk
of text in which a piece is not the remembered one is encoded by the library.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from .textnum import _BYTE, _grown, chunks, mix64

#: Distinct pieces remembered by a worker (about 50 MB); beyond it the memory starts anew.
MEMORY = 500_000
SLOTS_BITS = 20
#: Bytes of pieces encoded in one call.
CALL_BYTES = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PRINTED = np.zeros(256, bool)
_PRINTED[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = _PRINTED & ~_LETTER
#: Second bytes of Latin-1 letters after 0xC3 (all but the signs of multiplication and division).
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False

_encoders: dict[tuple[str, bool], Encoder] = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, added: bool = True) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if (path, added) not in _encoders:
        _encoders[path, added] = Encoder(path, added)
    return _encoders[path, added]


class Encoder:
    def __init__(self, path: str, added: bool = True) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        tokens = list(self.tokenizer.get_added_tokens_decoder().values())
        if not added:
            self.tokenizer.encode_special_tokens = True
            tokens = [t for t in tokens if not t.special]
        if any(t.lstrip or t.rstrip or t.single_word for t in tokens):
            raise ValueError("an added token takes the characters around it")
        words = sorted((t.content.encode() for t in tokens), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, words))) if words else None
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # a piece is never encoded twice
        self.size = self.tokenizer.get_vocab_size()
        # a byte-level token has one character for each of its bytes
        self.bytes = np.zeros(self.size, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = len(token)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(1 << SLOTS_BITS, np.uint64)  # 0: free
        self.place = np.zeros(1 << SLOTS_BITS, np.int32)
        self.flat = np.empty(1 << 20, np.uint16 if self.size <= 1 << 16 else np.uint32)
        self.text = np.empty(1 << 20, np.uint8)  # the pieces' bytes
        self.text_at = np.empty(1 << 16, np.int64)
        self.used = self.known = self.text_used = 0
        self.start = np.empty(1 << 16, np.int64)
        self.length = np.empty(1 << 16, np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Slots of hashes; -1 where unknown."""
        slot = (h >> np.uint64(64 - SLOTS_BITS)).astype(np.int64)
        at = self.keys[slot]
        todo = np.flatnonzero((at != h) & (at != 0))
        slot[at == 0] = -1
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << SLOTS_BITS) - 1)
            at = self.keys[slot[todo]]
            slot[todo[at == 0]] = -1
            todo = todo[(at != h[todo]) & (at != 0)]
        return slot

    def _insert(self, h: np.ndarray, place: np.ndarray) -> None:
        """New, distinct hashes into free slots."""
        slot = (h >> np.uint64(64 - SLOTS_BITS)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            took = free[first]
            self.keys[slot[took]], self.place[slot[took]] = h[took], place[took]
            todo = np.setdiff1d(todo, took, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << SLOTS_BITS) - 1)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Encode and store new pieces; their numbers."""
        joined = [k for k, p in enumerate(pieces) if _SPACE[p[0]] and (_PRINTED[p[-1]] or (len(p) > 2 and p[-2] == 0xC3 and _LATIN[p[-1]]))]
        alone = sorted(set(range(len(pieces))) - set(joined))
        number = np.empty(len(pieces), np.int64)
        at = 0
        while at < len(joined):
            sizes, end, total = [], at, 0
            while end < len(joined) and total < CALL_BYTES:
                sizes.append(len(pieces[joined[end]]))
                total += sizes[-1]
                end += 1
            part = joined[at:end]
            ids = np.array(self._encode([b"".join([pieces[k] for k in part]).decode()])[0], np.uint32)
            upto, ends = np.cumsum(self.bytes[ids]), np.cumsum(sizes)
            last = np.searchsorted(upto, ends)
            if upto[-1] == total and (upto[last] == ends).all():
                number[part] = self._store(ids, last + 1)
            else:
                raise ValueError("the tokenizer is not byte-level with the usual word pattern")
            at = end
        if alone:
            each = self._encode([pieces[k].decode() for k in alone])
            number[alone] = self._store(np.concatenate([np.array(x, np.uint32) for x in each]), np.cumsum([len(x) for x in each]))
        return number

    def _store(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(ends)
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.start) < self.known + n:
            self.start, self.length, self.text_at = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.length, self.text_at))
        self.flat[self.used : self.used + len(ids)] = ids
        begins = np.concatenate([[0], ends[:-1]])
        numbers = np.arange(self.known, self.known + n)
        self.start[numbers], self.length[numbers] = self.used + begins, ends - begins
        self.used += len(ids)
        self.known += n
        return numbers

    def _remember(self, pieces: list[bytes], numbers: np.ndarray) -> None:
        raw, sizes = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces])
        while len(self.text) < self.text_used + len(raw):
            self.text = np.concatenate([self.text, np.empty_like(self.text)])
        self.text[self.text_used : self.text_used + len(raw)] = raw
        self.text_at[numbers] = self.text_used + np.cumsum(sizes) - sizes
        self.text_used += len(raw)

    def _pieces(self, raw: np.ndarray, begins: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """Where pieces start in a buffer of texts that start at ``begins``."""
        before, c3 = raw[:-1], np.concatenate([[False], raw[:-2] == 0xC3]) if len(raw) > 1 else np.zeros(0, bool)
        letter = _LETTER[before] | (c3 & _LATIN[before])
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:-1] = (_SPACE[raw[1:]] & (_PRINTED[before] | letter)) | (_SIGN[raw[1:]] & letter)
        if self.added:
            for first, text in zip(begins.tolist(), texts):
                for m in self.added.finditer(text):
                    cut[first + m.start() : first + m.end()] = False
                    cut[[first + m.start(), first + m.end()]] = True
        cut[begins] = True
        return np.flatnonzero(cut[:-1])

    def batch(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each UTF-8 text."""
        for begin, end in chunks(texts):
            some = texts[begin:end]
            buffer = b"".join(some)
            raw = np.frombuffer(buffer, np.uint8)
            stops = np.cumsum([len(t) for t in some])
            begins = np.concatenate([[0], stops[:-1]])
            if not len(raw):
                yield from (np.empty(0, self.flat.dtype) for _ in some)
                continue
            start = self._pieces(raw, begins, some)
            stop = np.append(start[1:], len(raw))
            up, down = _grown(len(raw) + 1)
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
            h = mix64((total[stop] - total[start]) * down[start]) | np.uint64(1)
            slot = self._find(h)
            fresh = np.flatnonzero(slot < 0)
            if len(fresh):
                new, first = np.unique(h[fresh], return_index=True)
                if self.known + len(new) > MEMORY:
                    self.forget()
                    new, first = np.unique(h, return_index=True)
                    fresh = np.arange(len(h))
                which = fresh[first]
                if len(new) > MEMORY:  # a single text with more distinct pieces than that
                    yield from (np.array(x, self.flat.dtype) for x in self._encode([t.decode() for t in some]))
                    continue
                pieces = [buffer[a:b] for a, b in zip(start[which].tolist(), stop[which].tolist())]
                numbers = self._learn(pieces)
                self._remember(pieces, numbers)
                self._insert(new, numbers)
                slot = self._find(h)
            number = self.place[slot]
            same = self.text[(np.arange(len(raw)) + np.repeat(self.text_at[number] - start, stop - start)) % self.text_used] == raw
            if not same.all():  # two pieces of one hash
                yield from (np.array(x, self.flat.dtype) for x in self._encode([t.decode() for t in some]))
                continue
            n = self.length[number].astype(np.int64)
            ends = np.cumsum(n)
            ids = self.flat[np.arange(ends[-1]) + np.repeat(self.start[number] - (ends - n), n)]
            upto = np.concatenate([[0], ends])[np.searchsorted(start, np.concatenate([begins, [len(raw)]]))]
            for a, b in zip(upto[:-1].tolist(), upto[1:].tolist()):
                yield ids[a:b]
