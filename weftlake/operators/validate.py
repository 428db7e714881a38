"""Rules on extracted fields: each is a column expression, results are arrays of rule names."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates

# Strings that stand for nothing; a schema's words given back as a value.
PLACEHOLDERS = ("n/a", "na", "none", "null", "nil", "-", "--", "—", "unknown", "unspecified", "not available", "not applicable", "not found", "no data", "tbd", "todo", "undefined", "nan", "empty", "blank", "?", "...", "[]", "{}")
ECHOES = ("string", "number", "integer", "boolean", "float", "array", "object", "list", "list of strings", "text", "date", "value", "field", "example", "your answer here")
# Fixed value: how a model declines.
REFUSAL = r"(?i)^\s*(i'?m sorry|i cannot|i can'?t|i am unable|as an ai|i don'?t have|unfortunately,? (i|the)|there is no|no information (is )?(available|provided)|the (text|content|page) (does not|doesn'?t) )"
MAX_CHARS = 20_000
# Names of fields that hold links, addresses of mail, dates.
URL_FIELD, EMAIL_FIELD, DATE_FIELD = r"(?i)(url|link|href|image|logo|thumbnail|photo)s?$", r"(?i)e?mail", r"(?i)(date|published|updated|modified|created|时间)"
WARNINGS = ("url_shape", "email_shape", "future_date")


def rules(field: str, value: Column, prompt: Column | None = None, as_of: Column | None = None) -> dict[str, Column]:
    """Rule name -> whether a string value breaks it; only those that apply to the field's name."""
    low = F.lower(F.trim(value))
    out = {
        "placeholder": low.isin(*PLACEHOLDERS),
        "schema_echo": low.isin(*ECHOES),
        "refusal": value.rlike(REFUSAL),
        "lorem_ipsum": value.rlike("(?i)lorem ipsum|dolor sit amet"),
        "oversized_field": F.length(value) > MAX_CHARS,
    }
    if re.search(URL_FIELD, field):
        out["url_shape"] = (low != "") & ~value.rlike("^(?:https?://|data:|//)")
    if re.search(EMAIL_FIELD, field):
        out["email_shape"] = (low != "") & ~F.trim(value).rlike(r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$")
    if re.search(DATE_FIELD, field) and as_of is not None:
        out["future_date"] = dates.parse_date(value, as_of) > F.add_months(as_of.cast("date"), 12)
    if prompt is not None:
        out["prompt_echo"] = (F.length(value) >= 25) & (F.trim(prompt) != "") & F.contains(F.lower(F.trim(prompt)), low)
    return {k: F.coalesce(c, F.lit(False)) for k, c in out.items()}


def validate(df: DataFrame, fields: Sequence[str], prompt: str | None = None, as_of: Column | None = None, required: Sequence[str] = ()) -> DataFrame:
    """Add errors and warnings: ``field:rule`` of string fields (arrays element by element)."""
    errors, warnings, empty = [], [], []
    kinds = dict(df.dtypes)
    for f in fields:
        c = F.col(f)
        if kinds[f] == "array<string>":
            broken = lambda name: F.exists(c, lambda v: rules(f, v, F.col(prompt) if prompt else None, as_of)[name])  # noqa: B023, E731
            empty.append(c.isNull() | (F.size(c) == 0))
        else:
            broken = lambda name: rules(f, c.cast("string"), F.col(prompt) if prompt else None, as_of)[name]  # noqa: B023, E731
            empty.append(c.isNull() | (F.trim(c.cast("string")) == ""))
        for name in rules(f, F.lit(""), F.lit("") if prompt else None, as_of):
            (warnings if name in WARNINGS else errors).append(F.when(broken(name), F.lit(f"{f}:{name}")))
    errors += [F.when(empty[fields.index(f)], F.lit(f"{f}:required")) for f in required]
    errors.append(F.when(F.array_min(F.array(*empty)), F.lit("nothing was extracted")))
    said = lambda cs: F.filter(F.array(*cs), lambda x: x.isNotNull()) if cs else F.array().cast("array<string>")
    return df.withColumn("errors", said(errors)).withColumn("warnings", said(warnings)).withColumn("valid", F.size("errors") == 0)


def fill_rate(fields: Sequence[str]) -> Column:
    """The share of fields that hold something."""
    full = [F.when(F.col(f).isNotNull() & (F.trim(F.col(f).cast("string")) != ""), 1.0).otherwise(0.0) for f in fields]
    return sum(full[1:], full[0]) / len(fields)
