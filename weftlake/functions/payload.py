"""Answers of a model and records of a schema: found, fitted, checked and given typed companions."""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, MapType, StringType, StructType

from . import dates, numbers, schema, urls
from . import text as T

# Names of fields whose values get typed companions, in this order.
MONEY_FIELD = r"(?i)price|cost|salary|amount|fee|revenue|total|budget|wage"
DATE_FIELD = r"(?i)date|published|updated|modified|created|deadline|expires|_at$"
URL_FIELD = r"(?i)(?:url|link|href|image|logo|thumbnail|photo|avatar)s?$"
INT_FIELD = r"(?i)count|_count$|quantity|qty|pages?|views?|likes?|year"
FLOAT_FIELD = r"(?i)rating|score|percent|ratio|average|latitude|longitude"
IMAGES = ("image", "images", "thumbnail", "logo")
YES, NO = ("true", "yes", "y", "1"), ("false", "no", "n", "0")
#: Messages that a model is shown, for ``most``.
MESSAGES = 20


# --- text of a model ---------------------------------------------------------


def strip_fences(raw: Column) -> Column:
    """Without the fence lines that models put around JSON."""
    text = F.trim(raw)
    inside = F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*(?:\n|$)", ""), r"(?:^|\n)[ \t]*```[^\n]*$", "")
    return F.when(text.startswith("```"), F.trim(inside)).otherwise(text)


@F.pandas_udf(StringType())
def _outermost(texts: pd.Series) -> pd.Series:
    """The first JSON value in each text, by a JSON reader; without one, the text from its first bracket on."""
    decoder = json.JSONDecoder(strict=False)

    def find(t: str | None) -> str | None:
        first = re.search(r"[{\[]", t or "")
        if not first:
            return t
        try:
            return t[first.start() : decoder.raw_decode(t, first.start())[1]]
        except ValueError:
            return t[first.start() :]

    return texts.map(find)


def json_from_text(raw: Column) -> Column:
    """The outermost JSON of a chatty answer; the text itself where it starts with one or holds none."""
    text = strip_fences(raw)
    return F.when(text.rlike(r"^[{\[]"), text).otherwise(_outermost(text))


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """All named and numbered entities as characters, trimmed."""
    return texts.map(lambda t: None if t is None else (entities.unescape(t) if "&" in t else t).strip())


@F.arrow_udf(StringType())
def fragment_text(texts: pa.Array) -> pa.Array:
    """Text of an HTML fragment, pieces joined by a space; one at a time becomes an object of Python."""
    from ..operators import html

    read = lambda t: "" if not t else html.parse(t).text(" ") if "<" in t or "&" in t else t.strip()
    return pa.array((read(t.as_py()) for t in texts), pa.string(), size=len(texts))


# --- payloads and schemas ----------------------------------------------------


def difference(payload: Column, fields: Sequence[str], closed: bool = True) -> Column:
    """Messages about a JSON object's keys: fields that are absent, then (``closed``) keys that are not in the schema."""
    keys = F.array_sort(F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")))
    wanted = F.array(*[F.lit(f) for f in sorted(fields)])
    absent = F.transform(F.array_except(wanted, keys), lambda k: F.concat(k, F.lit(": required field is absent")))
    extra = F.transform(F.array_except(keys, wanted), lambda k: F.concat(k, F.lit(": field is not in the schema")))
    return F.concat(absent, extra) if closed else absent


def _accepts(kind: DataType, value: Column) -> Column:
    """Whether a JSON value (VARIANT) is of a compiled field's type; null is always accepted."""
    said = F.schema_of_variant(value)
    if isinstance(kind, ArrayType):
        fits = said.startswith("ARRAY")
    elif isinstance(kind, BooleanType):
        fits = said == "BOOLEAN"
    elif isinstance(kind, LongType):
        fits = said == "BIGINT"
    elif isinstance(kind, StringType):
        fits = (said == "STRING") | (said == "BIGINT") | (said == "DOUBLE") | said.startswith("DECIMAL")
    else:
        fits = F.lit(True)
    return value.isNull() | (said == "VOID") | fits


def _first(messages: Column, most: int | None) -> Column:
    if most is None:
        return messages
    more = F.when(F.size(messages) > most, F.array(F.concat((F.size(messages) - most).cast("string"), F.lit(" more"))))
    return F.concat(F.slice(messages, 1, most), F.coalesce(more, F.array().cast("array<string>")))


def validate(payload: Column, hint: dict, most: int | None = None) -> Column:
    """Problems of a JSON payload against a compiled hint: shape, keys, then types; with ``most`` a last one says how many more there are."""
    compiled = schema.compile_hint(hint)
    v = F.try_parse_json(payload)
    wrong = [F.when(~_accepts(f.dataType, F.try_variant_get(v, f"$['{f.name}']", "variant")), F.lit(f"{f.name}: is not of type {f.dataType.simpleString()}")) for f in compiled.fields]
    types = F.filter(F.array(*wrong), lambda x: x.isNotNull())
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return F.when(~is_object, F.array(F.lit("expected a JSON object"))).otherwise(_first(F.concat(difference(payload, list(hint)), types), most))


def unwrapped(payload: Column, fields: Sequence[str]) -> Column:
    """The object inside a single-key envelope, if it has one of the fields; otherwise the payload."""
    outer = F.json_object_keys(payload)
    inner = F.get(F.map_values(F.from_json(payload, "map<string,string>")), F.lit(0))
    known = F.arrays_overlap(F.coalesce(F.json_object_keys(inner), F.array().cast("array<string>")), F.array(*[F.lit(f) for f in fields]))
    return F.when((F.size(outer) == 1) & inner.startswith("{") & known, inner).otherwise(payload)


def coerce(df: DataFrame, column: str, hint: dict, into: str = "payload") -> DataFrame:
    """Add ``into``: a near-miss payload as STRUCT of the hint's types, with ``extras``, the keys it does not ask for.

    Envelopes are opened, keys meet by letters and digits alone, scalars and
    lists become each other, numbers and booleans are read from text.  What
    several fields need is a column of its own first, so it is read once.
    """
    compiled = schema.compile_hint(hint).fields
    plain = {f.name: re.sub("[^a-z0-9]", "", f.name.lower()) for f in compiled}
    out = df.withColumn("_p", unwrapped(F.col(column), list(hint))).withColumn("_m", F.from_json("_p", "map<string,string>"))
    found = lambda key: F.try_element_at(F.map_values(F.map_filter("_m", lambda k, v: schema.normalize_key(k) == key)), F.lit(-1))
    raws = {f"_r{i}": F.nullif(found(key), F.lit("")) for i, key in enumerate(plain.values())}
    out = out.withColumns(raws)
    fields = [fitted(F.col(f"_r{i}"), f.dataType).alias(f.name) for i, f in enumerate(compiled)]
    extras = F.map_filter("_m", lambda k, v: ~schema.normalize_key(k).isin(*plain.values()))
    return out.withColumn(into, F.struct(*fields, extras.alias("extras"))).drop("_p", "_m", *raws)


def fitted(v: Column, kind: DataType) -> Column:
    """A value as text, or as JSON of a list, as its type; what cannot be read is null."""
    listed = F.from_json(v, "array<string>")
    if isinstance(kind, ArrayType):
        parts = F.filter(F.transform(F.split(v, ","), lambda x: F.trim(x)), lambda x: x != "")
        many = F.when(v.startswith("["), listed).when(v.contains(","), parts).when(v.isNotNull(), F.array(v)).otherwise(F.array().cast("array<string>"))
        return many if isinstance(kind.elementType, StringType) else F.transform(many, lambda x: x.try_cast(kind.elementType))
    one = F.when(v.startswith("["), F.when(F.size(listed) > 0, F.array_join(listed, ", "))).otherwise(v)
    if isinstance(kind, LongType):
        digits = F.regexp_replace(one, r"[^\d-]", "")
        return F.when(digits.rlike(r"^-*\d+$"), digits.try_cast("bigint"))
    if isinstance(kind, DoubleType):
        return F.regexp_replace(one, r"[^\d.\-]", "").try_cast("double")
    if isinstance(kind, BooleanType):
        low = F.lower(F.trim(one))
        return F.when(low.isin(*YES), F.lit(True)).when(low.isin(*NO), F.lit(False))
    return one


def scalarish(value: Column) -> Column:
    """Whether a VARIANT is a scalar, or a list of scalars: simple enough to offer to a schema."""
    said = F.schema_of_variant(value)
    return F.coalesce((said != "VOID") & ~said.startswith("OBJECT") & ~said.rlike(r"^ARRAY<(?:OBJECT|ARRAY|VARIANT|VOID)"), F.lit(False))


# --- records -----------------------------------------------------------------


def clean_nested(value: Column, kind: DataType, nfkc: bool = True) -> Column:
    """Strings cleaned at any depth of a typed value; empty ones become null, and lists drop nulls."""
    if isinstance(kind, StringType):
        clean = T.clean_text(value, nfkc=False)
        return F.nullif(clean, F.lit(""))
    if isinstance(kind, ArrayType):
        return F.filter(F.transform(value, lambda x: clean_nested(x, kind.elementType)), lambda x: x.isNotNull())
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda k, v: clean_nested(v, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[clean_nested(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value


def normalize_record(df: DataFrame, fields: Sequence[str], base_url: Column | None = None, dayfirst: bool = False, typed: bool = True) -> DataFrame:
    """Fields cleaned, and companions beside them by their names: _amount, _currency, _iso, _ambiguous, _value.

    The string that was seen stays; a relative address in a URL field is made absolute.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = df.withColumns({f: clean_nested(F.col(f), kinds[f]) for f in fields})
    for f in fields if typed else ():
        if not isinstance(kinds[f], StringType):
            continue
        if re.search(MONEY_FIELD, f):
            out = out.withColumn("_m", numbers.money(F.col(f))).withColumns({f"{f}_amount": F.col("_m.amount"), f"{f}_currency": F.when(F.col("_m.amount").isNotNull(), F.col("_m.currency"))}).drop("_m")
        elif re.search(DATE_FIELD, f):
            out = out.withColumn("_d", dates.date_field(F.col(f), dayfirst=dayfirst)).withColumns({f"{f}_iso": F.col("_d.iso"), f"{f}_ambiguous": F.when(F.col("_d.iso").isNotNull(), F.col("_d.ambiguous"))}).drop("_d")
        elif re.search(URL_FIELD, f):
            if base_url is not None:
                out = out.withColumn(f, F.when(F.col(f).rlike("^(?:http|data:)"), F.col(f)).otherwise(urls.resolve(base_url, F.col(f))))
        elif re.search(INT_FIELD, f):
            out = out.withColumn(f"{f}_value", numbers.parse_int(F.col(f)))
        elif re.search(FLOAT_FIELD, f):
            out = out.withColumn(f"{f}_value", numbers.parse_number(F.col(f)))
    return out


def absolute_images(df: DataFrame, base_url: Column) -> DataFrame:
    """Relative image addresses of a record made absolute."""
    whole = lambda v: F.when((v == "") | v.rlike("^(?:http|data:)"), v).otherwise(urls.resolve(base_url, v))
    kinds = dict(df.dtypes)
    return df.withColumns({f: F.transform(f, whole) if kinds[f].startswith("array") else whole(F.col(f)) for f in IMAGES if f in kinds})
