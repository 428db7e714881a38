"""Evaluate an expression once and use its value many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(values: dict, key: Column) -> Column:
    """``values[key]`` with the key evaluated once; null for another key."""
    return F.try_element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))]), key)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value in a lambda's variable.

    Where a body names its input many times, written out it would be evaluated,
    and compiled, as often.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
