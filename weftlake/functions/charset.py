"""Charsets told from the bytes alone: likelihoods of byte pairs for each code page and language, learned from texts.

Pairs of characters are counted by language over a whole table of texts.  For
every code page a pair of bytes is as likely as the pair of characters that it
stands for; a text's bytes are read in the page, and for the language, under
which their pairs are likeliest.  Pages that share ASCII differ in a few letters
whose neighbours tell more than pairs do (a capital after a full stop and a
space): there the windows around those letters decide, each once however often
it is repeated, by the texts of any language that have them, and the pairs where
windows are alike.  Marks, valid UTF-8 and UTF-16 are told first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .policy import told_by_form

#: Single-byte code pages, the commoner first: of equal readings the first counts.
PAGES = ("cp1252", "mac_roman", "cp850", "cp437", "cp1250", "cp860", "cp037", "cp500")
#: Pairs never seen count as this many.
UNSEEN = 0.01
#: The share of all languages' pairs in each language: texts hold lines of other ones.
SHARED = 0.01
#: Characters on each side of one beyond ASCII that make its window with it.
REACH = 2
#: Windows never seen stand in this many texts.
UNSEEN_WINDOW = 1e-5


def _characters(pages: Sequence[str]) -> dict[str, int]:
    """All characters that some page can write, numbered; 0 stands for every other."""
    every = sorted({c for p in pages for c in bytes(range(256)).decode(p, "ignore")})
    return {c: k + 1 for k, c in enumerate(every)}


def _places(page: str, known: dict[str, int]) -> np.ndarray:
    """The number of the character that each byte stands for in a page."""
    return np.array([known.get(bytes([b]).decode(page, "ignore"), 0) for b in range(256)])


def _around(codes: np.ndarray, at: np.ndarray, outside: int) -> np.ndarray:
    """The windows at the places ``at``, each once, as columns; ``outside`` stands for what is beyond the text."""
    where = at + np.arange(-REACH, REACH + 1)[:, None]
    windows = np.where((where >= 0) & (where < len(codes)), codes[np.clip(where, 0, len(codes) - 1)], outside)
    return windows[:, np.unique(_hashed(windows), return_index=True)[1]]


def _hashed(windows: np.ndarray) -> np.ndarray:
    found = np.zeros(windows.shape[1], np.uint64)
    for row in windows:
        found = (found ^ (row + 1).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(32)
    return found.view(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of characters of each language, and under no language how many texts have a window."""
    known = _characters(PAGES)
    size = len(known) + 1
    beyond = min((k for c, k in known.items() if c > "\x7f"), default=size)
    table = np.zeros(0x110000, np.int64)
    for c, k in known.items():
        table[ord(c)] = k
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        windows = [np.zeros(0, np.int64)]
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            codes = table[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
            if len(codes) > 1:
                have = found.setdefault(lang, np.zeros(size * size, np.int64))
                pairs, n = np.unique(codes[:-1] * size + codes[1:], return_counts=True)
                have[pairs] += n
                windows.append(_hashed(_around(codes, np.flatnonzero(codes >= beyond), -1)))
        seen, n = np.unique(np.concatenate(windows), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(seen), pa.string()), pa.array(seen), pa.array(n)], names=["lang", "pair", "n"])
    for lang, have in found.items():
        at = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(have[at])], names=["lang", "pair", "n"])


class Model:
    """Log likelihoods of byte pairs, (page, language) -> 65,536 numbers; hashes of windows in order and in how many texts they stand."""

    def __init__(self, tables: dict[tuple[str, str], np.ndarray], windows: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.names = list(tables)
        self.tables = np.stack(list(tables.values())) if tables else np.zeros((0, 65536), np.float32)
        self.windows, known, ascii_ = windows, _characters(PAGES), bytes(range(128))
        self.places = {p: np.append(_places(p, known), -1) for p in dict(self.names) if ascii_.decode(p, "ignore") == ascii_.decode("ascii")}

    def seen(self, windows: np.ndarray) -> float:
        """The log likelihood of windows, each by itself."""
        known, texts = self.windows
        hashes = _hashed(windows)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return float(np.log(np.where(known[at] == hashes, texts[at], UNSEEN_WINDOW)).sum())

    def guess(self, raw: bytes) -> tuple[str, str] | None:
        """The page and language under which the bytes are likeliest; none without a pair or a model."""
        codes = np.frombuffer(raw, np.uint8).astype(np.int64)
        if len(codes) < 2 or not self.names:
            return None
        pairs, n = np.unique(codes[:-1] * 256 + codes[1:], return_counts=True)
        scores = self.tables[:, pairs] @ n
        best = self.names[int(scores.argmax())]
        if self.windows is None or best[0] not in self.places:
            return best
        windows = _around(codes, np.flatnonzero(codes > 127), 256)
        seen = {p: self.seen(places[windows]) for p, places in self.places.items()}
        return max((k for k in zip(self.names, scores) if k[0][0] in seen), key=lambda k: (seen[k[0][0]], k[1]))[0]

    def read(self, raw: bytes | None, whole: bool = False) -> tuple[str | None, str | None, str | None]:
        """Text, charset and language (null where the form alone told the charset); nulls for no text, also for white space unless it is to be kept ``whole``."""
        if not raw:
            return "" if whole and raw is not None else None, None, None
        text, charset = told_by_form(raw)
        lang = None
        if text is None:
            charset, lang = self.guess(raw) or ("cp1252", None)
            text = raw.decode(charset, "replace")
        return (text, charset, lang) if whole or text.strip() else (None, None, None)


def learn(texts: DataFrame, lang: str = "lang", text: str = "text", pages: Sequence[str] = PAGES) -> Model:
    """A model of all texts of a table; what comes to the driver is one row for each language and pair of characters of the pages, and one for each window."""
    rows = texts.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.col(text).alias("text")).filter("text is not null")
    counts = rows.mapInArrow(_counts, "lang string, pair long, n long").groupBy("lang", "pair").agg(F.sum("n").alias("n")).toArrow()
    known = _characters(PAGES)
    size = len(known) + 1
    seen = counts.filter(pc.is_null(counts.column("lang"))).sort_by("pair")
    counts = counts.filter(pc.is_valid(counts.column("lang")))
    windows = (seen.column("pair").to_numpy(), seen.column("n").to_numpy()) if len(seen) else None
    langs, pairs, n = np.array(counts.column("lang").to_pylist()), counts.column("pair").to_numpy(), counts.column("n").to_numpy()
    tables = {}
    every = np.bincount(pairs, n, size * size) if len(pairs) else np.zeros(size * size)
    places = {p: _places(p, known) for p in pages}
    for name in sorted(set(langs.tolist())):
        have = UNSEEN + SHARED * every
        have[pairs[langs == name]] += n[langs == name]
        have = have.reshape(size, size)
        have[0], have[:, 0] = UNSEEN / size, UNSEEN / size  # bytes that the page does not use, characters of no page
        likely = np.log(have / have.sum()).astype(np.float32)
        for p in pages:
            tables[p, name] = likely[np.ix_(places[p], places[p])].ravel()
    order = sorted(tables, key=lambda k: (pages.index(k[0]), k[1]))
    return Model({k: tables[k] for k in order}, windows)


_READ = StructType([StructField(n, StringType()) for n in ("text", "charset", "language")])


def decoded(raw: Column, model: Model, whole: bool = False) -> Column:
    """STRUCT<text,charset,language> of BINARY, ``whole`` as in ``Model.read``; the model travels with the tasks (a quarter MB for each language and page, 16 bytes for each window)."""

    @F.pandas_udf(_READ)
    def read(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.read(v, whole) for v in values], columns=["text", "charset", "language"], dtype=object)

    return read(raw)


@F.pandas_udf(BinaryType())
def encoded(text: pd.Series, page: pd.Series) -> pd.Series:
    """Bytes of texts in their code pages; UTF-8 where the page lacks a character or the text is white space, with a mark before a text that begins with one."""

    def one(t: str | None, p: str | None) -> bytes | None:
        if t is None:
            return None
        try:
            return t.encode(p if p and t.strip() else "utf-8")
        except (UnicodeEncodeError, LookupError):
            return t.encode("utf-8-sig" if t.startswith("\ufeff") else "utf-8")

    return pd.Series([one(t, p) for t, p in zip(text, page)], dtype=object)
