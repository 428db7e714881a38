"""Dates in free text, against an explicit present."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import bind, lookup

# Formats in the order in which they are tried (Spark's letters), each with the shape of its texts.
FORMATS = (
    (r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}[+-]\d{4}", "y-M-d'T'H:m:sxx"), (r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}[+-]\d{4}", "y-M-d'T'H:m:s.SSSSSSxx"),
    (r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}", "y-M-d'T'H:m:s"), (r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}", "y-M-d H:m:s"), (r"\d{4}-\d{1,2}-\d{1,2}", "y-M-d"),
    (r"\d{4}/\d{1,2}/\d{1,2}", "y/M/d"), (r"\d{4}\.\d{1,2}\.\d{1,2}", "y.M.d"), (r"\d{8}", "yyyyMMdd"),
    (r"\d{1,2} [A-Z][a-z]{3,8} \d{4}", "d MMMM y"), (r"\d{1,2} [A-Z][a-z]{2} \d{4}", "d MMM y"), (r"[A-Z][a-z]{3,8} \d{1,2}, \d{4}", "MMMM d, y"), (r"[A-Z][a-z]{2} \d{1,2}, \d{4}", "MMM d, y"),
    (r"[A-Z][a-z]{3,8} \d{1,2} \d{4}", "MMMM d y"), (r"[A-Z][a-z]{2} \d{1,2} \d{4}", "MMM d y"), (r"\d{1,2}-\d{1,2}-\d{4}", "d-M-y"), (r"\d{1,2}-\d{1,2}-\d{4}", "M-d-y"), (r"\d{1,2}\.\d{1,2}\.\d{4}", "d.M.y"),
    (r"[A-Z][a-z]{2}, \d{1,2} [A-Z][a-z]{2} \d{4} \d{1,2}:\d{1,2}:\d{1,2} [+-]\d{4}", "d MMM y H:m:s xx"),
    (r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}", "y-M-d'T'H:m"), (r"[A-Z][a-z]{3,8} \d{4}", "MMMM y"), (r"[A-Z][a-z]{2} \d{4}", "MMM y"), (r"\d{4}", "y"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "d/M/y"), (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/y"),
)
#: Seconds of a unit; a month has 30.44 days and a year 365.25.
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400, "month": int(30.44 * 86400), "year": int(365.25 * 86400)}
#: Beginnings that tell shapes apart before they are tried: year first, digits, a name.
STARTS = (r"\d{4}[-/.]", r"\d", "[A-Z]")
# Shapes that could be read either way, and how far back something was.
_AMBIGUOUS = r"^\s*(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})\s*$"
_AGO = r"(?i)^\s*(\d+)\s+(second|minute|hour|day|week|month|year)s?\s+ago\s*$"


def _start(shape: str) -> str:
    if shape.startswith("["):
        return STARTS[2]
    return STARTS[0] if shape.startswith((r"\d{4}-", r"\d{4}/", r"\d{4}\.")) else STARTS[1]


def is_ambiguous(text: Column) -> Column:
    """Whether day and month could be exchanged."""
    a, b = (F.regexp_extract(text, _AMBIGUOUS, k).cast("int") for k in (1, 2))
    return F.coalesce(F.when(text.rlike(_AMBIGUOUS), (a <= 12) & (b <= 12) & (a != b)), F.lit(False))  # digits alone are cast


def _reread(text: Column, dayfirst: bool) -> Column:
    """A text of the shape d/m/y under the chosen convention; null where only one reading is possible."""
    a, b, y = (F.regexp_extract(text, _AMBIGUOUS, k).cast("int") for k in (1, 2, 3))
    year = F.when(y < 70, y + 2000).when(y < 100, y + 1900).otherwise(y)
    day, month = (a, b) if dayfirst else (b, a)
    return F.when((a <= 12) & (b <= 12), F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0)))


def parse_date(text: Column, as_of: Column | None = None, dayfirst: bool = False) -> Column:
    """TIMESTAMP (UTC session) or null: relative to ``as_of``, the formats in order, then ISO."""
    return bind(F.trim(text), lambda t: _parsed(t, as_of, dayfirst))


def _normal(t: Column) -> Column:
    """Without a zone's name in brackets; offsets as four digits."""
    cut = F.regexp_replace(t, r"\s+\([A-Z]{2,5}\)\s*$", "")
    return F.regexp_replace(F.when(cut.endswith("Z"), F.replace(cut, F.lit("Z"), F.lit("+0000"))).otherwise(cut), r"([+-]\d{2}):(\d{2})$", "$1$2")


def _by_format(norm: Column, dayfirst: bool) -> Column:
    tries: dict[str, list[Column]] = {start: [] for start in STARTS}
    for shape, fmt in FORMATS:
        value = F.regexp_replace(norm, r"^[A-Z][a-z]{2}, ", "") if fmt == "d MMM y H:m:s xx" else norm
        if ".SSSSSS" in fmt:  # digits of a second are filled up to six
            value = F.concat(F.regexp_extract(norm, r"^(.*\.)", 1), F.rpad(F.regexp_extract(norm, r"\.(\d+)", 1), 6, "0"), F.regexp_extract(norm, r"([+-]\d{4})$", 1))
        tries[_start(shape)].append(F.when(norm.rlike(f"^(?:{shape})$"), F.try_to_timestamp(value, F.lit(fmt))))
    (first, of_first), *more = tries.items()
    found = F.when(norm.rlike(f"^{first}"), F.coalesce(*of_first))
    for start, of_start in more:
        found = found.when(norm.rlike(f"^{start}"), F.coalesce(*of_start))
    return bind(found, lambda read: F.coalesce(F.when(read.isNotNull() & norm.rlike(_AMBIGUOUS), _reread(norm, dayfirst)), read))


def _parsed(t: Column, as_of: Column | None, dayfirst: bool) -> Column:
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), t.try_cast("timestamp"))
    found = F.coalesce(bind(_normal(t), lambda n: _by_format(n, dayfirst)), iso)
    if as_of is not None:
        back = F.when(t.rlike(_AGO), F.regexp_extract(t, _AGO, 1).try_cast("long") * lookup(UNITS, F.lower(F.regexp_extract(t, _AGO, 2))))
        found = F.coalesce(F.when(back.isNotNull(), F.timestamp_seconds(F.unix_micros(as_of.cast("timestamp")) / 1_000_000 - back)), found)
    return F.when(t != "", found)


def date_field(text: Column, as_of: Column | None = None, dayfirst: bool = False) -> Column:
    """STRUCT<raw,iso,date,ambiguous>."""
    return bind(parse_date(text, as_of, dayfirst), lambda p: F.struct(text.alias("raw"), F.date_format(p, "yyyy-MM-dd'T'HH:mm:ssxxx").alias("iso"), F.date_format(p, "yyyy-MM-dd").alias("date"), is_ambiguous(text).alias("ambiguous")))
