"""Dates inside sentences: words and numbers as tokens, readings of neighbouring tokens ranked.

A token is a number (with what it could be: day, month, year), the name of a
month, or a clock time with its zone; weekdays, ordinals' endings and small
words between the parts of a date are passed over.  A reading uses a run of
tokens; the one that uses most counts, the first of equal ones.
"""

from __future__ import annotations

import datetime as dt
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

# The months' names in four languages, by their first letters that tell them apart.
MONTHS = {
    "jan": 1, "ene": 1, "jän": 1, "feb": 2, "fév": 2, "fev": 2, "mar": 3, "mär": 3, "apr": 4, "avr": 4, "abr": 4, "may": 5, "mai": 5,
    "jun": 6, "juin": 6, "jul": 7, "juil": 7, "aug": 8, "aoû": 8, "aou": 8, "ago": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "déc": 12, "dez": 12, "dic": 12,
}
WORDS = ("january february march april may june july august september october november december januar februar märz mai juni juli oktober dezember jänner "
         "janvier février fevrier mars avril juin juillet août aout septembre octobre novembre décembre enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre sept").split()
# Words between the parts of a date.
SMALL = ("of", "the", "de", "del", "le", "der", "den", "am", "at", "um", "à", "a", "las", "st", "nd", "rd", "th", "er", "t")
_TOKEN = re.compile(r"\d+|[^\W\d_]+|[^\w\s]|_")
_CLOCK = re.compile(r"(?<!\d)([01]?\d|2[0-3]):([0-5]\d)(?::([0-5]\d))?(?:[.,]\d+)?\s*(am\b|pm\b)?\s*(z\b|utc\b|gmt\b|[+-][01]\d:?[0-5]\d)?", re.I)
_SPELLED = {w: MONTHS.get(w[:4]) or MONTHS[w[:3]] for w in WORDS} | {k: v for k, v in MONTHS.items()}


def _tokens(text: str) -> list[tuple[str, int, str]]:
    """(kind, value, text) of a text's numbers and months; ``gap`` where anything but small words and marks stands between."""
    out: list[tuple[str, int, str]] = []
    for word in _TOKEN.findall(text.lower()):
        if word.isdecimal():
            out.append(("number", int(word[:9]), word))
        elif word in _SPELLED:
            out.append(("month", _SPELLED[word], word))
        elif word in SMALL or word in ".,/-'":
            continue
        else:
            out.append(("gap", 0, word))
    return out


def _year(value: int, text: str) -> int | None:
    if len(text) == 4 and 1000 <= value <= 2999:
        return value
    return None if len(text) != 2 else value + (2000 if value < 70 else 1900)


def _made(year: int | None, month: int, day: int) -> dt.date | None:
    try:
        return dt.date(year, month, day) if year else None
    except ValueError:
        return None


def _readings(run: list[tuple[str, int, str]], dayfirst: bool):
    """(rank, date) of the beginnings of a run of tokens; a named month before numbers alone, three parts before two."""
    kinds, values, texts = zip(*run[:3])
    if kinds == ("number", "month", "number"):
        yield 5, _made(_year(values[2], texts[2]), values[1], values[0])
        if len(texts[0]) == 4:
            yield 5, _made(_year(values[0], texts[0]), values[1], values[2])
    if kinds == ("month", "number", "number"):
        yield 5, _made(_year(values[2], texts[2]), values[0], values[1])
    if kinds == ("number", "number", "number"):
        if len(texts[0]) == 4:
            yield 4, _made(_year(values[0], texts[0]), values[1], values[2])
        for day, month, rank in ((0, 1, 3 + dayfirst), (1, 0, 4 - dayfirst)):
            yield rank, _made(_year(values[2], texts[2]), values[month], values[day])
    if kinds[:2] == ("month", "number") and len(texts[1]) == 4:
        yield 2, _made(_year(values[1], texts[1]), values[0], 1)
    if kinds[0] == "number" and len(texts[0]) == 8:
        yield 1, _made(values[0] // 10000, values[0] // 100 % 100, values[0] % 100)


def read(text: str | None, dayfirst: bool = False) -> dt.datetime | None:
    """The date that a text names, in UTC; None without one."""
    if not text:
        return None
    clock = _CLOCK.search(text)
    tokens = _tokens(_CLOCK.sub(" ", text) if clock else text)
    best, found = 0, None
    for k, (kind, _, _) in enumerate(tokens):
        if kind == "gap":
            continue
        run = tokens[k : k + 3]
        run = run[: next((n for n, t in enumerate(run) if t[0] == "gap"), 3)]
        for rank, date in _readings(run + [("gap", 0, "")] * (3 - len(run)), dayfirst):
            if date is not None and rank > best:
                best, found = rank, date
    if found is None:
        return None
    when = dt.datetime.combine(found, dt.time())
    if clock:
        hour, minute, second, half, zone = clock.groups()
        hour = int(hour) % 12 + (12 if half.lower() == "pm" else 0) if half and int(hour) <= 12 else int(hour)
        when += dt.timedelta(hours=hour, minutes=int(minute), seconds=int(second or 0))
        if zone and zone[0] in "+-":
            digits = zone[1:].replace(":", "")
            away = dt.timedelta(hours=int(digits[:2]), minutes=int(digits[2:]))
            when += -away if zone[0] == "+" else away
    return when


def find_date(dayfirst: bool = False):
    """A function of texts: TIMESTAMP (UTC session) of the date that each names."""

    @F.pandas_udf(TimestampType())
    def find(text: pd.Series) -> pd.Series:
        return pd.to_datetime(pd.Series([read(t, dayfirst) for t in text], dtype=object), errors="coerce")

    return find
