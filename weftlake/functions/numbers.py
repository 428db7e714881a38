"""Numbers and money in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import bind, lookup

# Currency signs and their codes, codes known without a sign, multipliers.
CURRENCIES = {
    "$": "USD", "US$": "USD", "£": "GBP", "€": "EUR", "¥": "JPY", "₹": "INR", "₨": "INR", "R$": "BRL", "₩": "KRW", "₽": "RUB", "₺": "TRY", "₪": "ILS",
    "CHF": "CHF", "kr": "SEK", "zł": "PLN", "₫": "VND", "฿": "THB", "₦": "NGN", "C$": "CAD", "A$": "AUD", "NZ$": "NZD", "HK$": "HKD", "S$": "SGD",
}
MORE_CODES = ("CNY", "AED", "SAR", "ZAR", "MXN", "NPR")
MULTIPLIERS = {"k": 10**3, "thousand": 10**3, "m": 10**6, "mn": 10**6, "million": 10**6, "b": 10**9, "bn": 10**9, "billion": 10**9, "t": 10**12, "trillion": 10**12, "lakh": 10**5, "crore": 10**7}
# A multiplier after a number, and what counts as a number.
_SCALE = r"(?i)\d\s*(" + "|".join(sorted(MULTIPLIERS, key=len, reverse=True)) + r")\b"
_NUMBER = r"[-+]?\d[\d.,\s ']*\d|[-+]?\d"


def plain_number(text: Column) -> Column:
    """The first number's digits with a decimal point, separators resolved; null without one.

    With both signs the last is the point.  Commas alone group thousands when
    there are several, or one before three digits with at most three before it;
    several points group thousands, a single one is a decimal point.
    """
    return bind(F.regexp_replace(F.regexp_extract(text, f"({_NUMBER})", 1), r"[\s ']", ""), _resolved)


def _resolved(raw: Column) -> Column:
    commas, dots = F.split(raw, ","), F.split(raw, r"\.")
    has_comma, has_dot = F.size(commas) > 1, F.size(dots) > 1
    dot_last = F.length(raw) - F.instr(F.reverse(raw), ".") > F.length(raw) - F.instr(F.reverse(raw), ",")
    grouped = (F.size(commas) > 2) | ((F.length(F.element_at(commas, -1)) == 3) & (F.length(F.get(commas, F.lit(0))) <= 3))
    no_commas, no_dots = F.replace(raw, F.lit(","), F.lit("")), F.replace(raw, F.lit("."), F.lit(""))
    return (
        F.when(raw == "", F.lit(None).cast("string"))
        .when(has_comma & has_dot, F.when(dot_last, no_commas).otherwise(F.replace(no_dots, F.lit(","), F.lit("."))))
        .when(has_comma, F.when(grouped, no_commas).otherwise(F.replace(raw, F.lit(","), F.lit("."))))
        .when(F.size(dots) > 2, no_dots)
        .otherwise(raw)
    )


def multiplier(text: Column) -> Column:
    """What the word after a number multiplies it by; 1 without such a word."""
    known = lookup({k: F.lit(v).cast("long") for k, v in MULTIPLIERS.items()}, F.lower(F.regexp_extract(text, _SCALE, 1)))
    return F.coalesce(known, F.lit(1).cast("long"))


def _product(plain: Column, times: Column) -> Column:
    return (plain.try_cast("decimal(25,9)") * times.cast("decimal(13,0)")).cast("decimal(38,9)")


def parse_decimal(text: Column) -> Column:
    """DECIMAL(38,9) of the first number in a text, times its multiplier."""
    return _product(plain_number(F.trim(text)), multiplier(text))


def amount(text: Column) -> Column:
    """The exact number as a string: as written without a multiplier, multiplied otherwise."""
    return bind(_parts(text), _amount)


def _parts(text: Column) -> Column:
    return F.struct(plain_number(F.trim(text)).alias("plain"), multiplier(text).alias("times"))


def _amount(parts: Column) -> Column:
    product = _product(parts["plain"], parts["times"]).cast("string")
    short = F.regexp_replace(F.regexp_replace(product, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(parts["times"] == 1, F.regexp_replace(parts["plain"], r"^\+", "")).otherwise(short)


def parse_number(text: Column) -> Column:
    return parse_decimal(text).cast("double")


def parse_int(text: Column) -> Column:
    """The number without its fraction; null beyond 64 bits."""
    return parse_decimal(text).try_cast("bigint")


def currency(text: Column) -> Column:
    """A known code if the first three-letter word is one, else the longest sign contained."""
    codes = {c: c for c in sorted({*CURRENCIES.values(), *MORE_CODES})}
    first, *more = sorted(CURRENCIES, key=lambda s: -len(s))
    by_sign = F.when(text.contains(first), F.lit(CURRENCIES[first]))
    for sign in more:
        by_sign = by_sign.when(text.contains(sign), F.lit(CURRENCIES[sign]))
    return F.coalesce(lookup(codes, F.regexp_extract(F.upper(text), r"\b([A-Z]{3})\b", 1)), by_sign)


def money(text: Column, default: str | None = None) -> Column:
    """STRUCT<raw,amount,currency>, read once however many of its fields are used."""
    return bind(_parts(text), lambda p: F.struct(text.alias("raw"), _amount(p).alias("amount"), F.coalesce(currency(text), F.lit(default)).alias("currency")))


def is_numeric_cell(text: Column) -> Column:
    """Whether a table cell reads as a number, thousands commas removed."""
    return F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double").isNotNull()
