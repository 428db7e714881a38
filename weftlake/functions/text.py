"""Text: cleaning, previews, words, shingles, fingerprints."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from .bind import bind

WORD = r"[\p{L}\p{N}_]+"
SHINGLE = 3


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def strip_invisibles(text: Column) -> Column:
    """Without format and control characters; line ends and tabs stay."""
    return F.regexp_replace(text, r"[\p{Cf}\p{Cc}&&[^\n\r\t]]", "")


def clean_text(text: Column, nfkc: bool = True) -> Column:
    """Compatibility forms composed, invisibles dropped, runs of space and of empty lines shortened."""
    c = strip_invisibles(_nfkc(text) if nfkc else text)
    c = F.regexp_replace(F.regexp_replace(c, r"[\s\x0B\p{Z}&&[^\n]]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def preview(text: Column, size: int = 280, nfkc: bool = True) -> Column:
    """At most ``size`` characters, cut at a sentence's end past the middle, else at a space."""
    def cut(c: Column) -> Column:
        head = F.substring(c, 1, size)
        sentence = F.regexp_extract(head, r"(?s)^(.*[.!?]) ", 1)
        short = F.when(F.length(sentence) > size * 0.5 + 1, sentence).when(head.contains(" "), F.regexp_extract(head, r"(?s)^(.*) ", 1)).otherwise(head)
        return F.when(c == "", F.lit(None).cast("string")).when(F.length(c) <= size, c).otherwise(F.concat(short, F.lit("…")))

    return bind(F.replace(clean_text(text, nfkc), F.lit("\n"), F.lit(" ")), cut)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def spaced_words(text: Column) -> Column:
    """The words of ``words`` as one text, a space between two."""
    return F.trim(F.regexp_replace(F.lower(text), WORD.replace("[", "[^"), " "))


def shingles(tokens: Column, size: int = SHINGLE) -> Column:
    """Runs of ``size`` words; fewer words are one run, none are none.

    The words are bound to a lambda's variable: written into the inner lambda,
    their expression would be evaluated for every run.
    """

    def runs(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, F.lit(size)), " "))
        return F.when(F.size(w) >= size, many).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return bind(tokens, runs)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bands(fingerprint: Column) -> Column:
    """Four 16-bit pieces of a 64-bit fingerprint, tagged by place."""
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (i.cast("long") * 65536 + F.call_function("shiftrightunsigned", fingerprint, i * 16).bitwiseAND(F.lit(65535).cast("long"))))


@F.pandas_udf(LongType())
def simhash_blake2b(word_lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """64-bit similarity fingerprint (bit pattern as a signed number) of words, over 8-byte BLAKE2b hashes of their runs.

    Takes words, not runs: Spark does not pass lambda expressions to Python functions.
    """
    for batch in word_lists:
        out = []
        for w in batch:
            w = [] if w is None else list(w)
            runs = [" ".join(w[k : k + SHINGLE]) for k in range(max(1, len(w) - SHINGLE + 1))] if w else []
            if not runs:
                out.append(0)
                continue
            raw = b"".join(hashlib.blake2b(x.encode(), digest_size=8).digest() for x in runs)
            ones = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            out.append(int(np.packbits(2 * ones > len(runs)).view(">i8")[0]))
        yield pd.Series(out, dtype="int64")


def content_hash(raw: Column, text: Column | None = None) -> Column:
    return F.sha2(raw if text is None else F.coalesce(raw, F.encode(text, "UTF-8")), 256)


def cache_key(content: Column, schema: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws("|", content, schema, prompt), 256)


def timestamped(segments: Column, offset: float = 0.0) -> Column:
    """``[mm:ss] text`` lines of ARRAY<STRUCT<start,end,text>>, moved by an offset."""
    full = F.filter(segments, lambda s: F.trim(s["text"]) != "")
    line = lambda s: F.format_string("[%02d:%02d] %s", F.floor((s["start"] + offset) / 60).cast("int"), (F.floor(s["start"] + offset) % 60).cast("int"), F.trim(s["text"]))
    return F.array_join(F.transform(full, line), "\n")
