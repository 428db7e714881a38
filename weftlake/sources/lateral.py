"""Blobs read from SQL: a table function whose columns come from the caller's hint.

``SELECT d.id, r.* FROM d, LATERAL read_blob(d.text, 'csv', '{"id": "integer"}') r``
after ``register(spark)``.  The schema is ``place``, the hint's fields and
``error``; a damaged blob is one row with ``error``, a null one gives no row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import schema as hints
from . import handlers

#: Kind -> what its rows offer to a hint's fields.
READERS = ("csv", "json", "xml", "yaml", "mail", "archive", "feed")


def _records(kind: str, blob: object) -> Iterator[dict]:
    if kind == "csv":
        yield from (r for (r,) in handlers.read_table(blob))
    elif kind == "json":
        text = blob.strip()
        try:
            value = json.loads(text)
        except ValueError:
            value = [json.loads(x) for x in text.splitlines() if x.strip()]
        yield from (v if isinstance(v, dict) else {"value": v} for v in (value if isinstance(value, list) else [value]))
    elif kind in ("xml", "yaml"):
        for (text,) in (handlers.read_xml if kind == "xml" else handlers.read_yaml)(blob):
            value = json.loads(text)
            yield value if isinstance(value, dict) else {"value": value}
    else:
        fields, read = handlers.NAMED[kind]
        yield from (dict(zip(fields, row)) for row in read(blob))


def _fitted(value: object, kind: DataType) -> object:
    """A value as the hint's type; null where it is not one."""
    if value is None:
        return None
    if isinstance(kind, ArrayType):
        return [_fitted(v, kind.elementType) for v in (value if isinstance(value, list) else [value])]
    if isinstance(kind, LongType):
        try:
            return int(str(value).strip())
        except ValueError:
            return None
    if isinstance(kind, BooleanType):
        return {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}.get(str(value).strip().lower())
    return value if isinstance(value, str) else value.decode("utf-8", "replace") if isinstance(value, bytes) else json.dumps(value, ensure_ascii=False, default=str)


def _row_schema(hint: str) -> StructType:
    fields = [StructField(f.name, f.dataType if isinstance(f.dataType, (ArrayType, LongType, BooleanType)) else StringType()) for f in hints.compile_hint(json.loads(hint)).fields]
    return StructType([StructField("place", IntegerType()), *fields, StructField("error", StringType())])


@udtf
class ReadBlob:
    @staticmethod
    def analyze(blob: AnalyzeArgument, kind: AnalyzeArgument, hint: AnalyzeArgument) -> AnalyzeResult:
        if not (kind.isConstantExpression and hint.isConstantExpression):
            raise ValueError("kind and hint are constants")
        if kind.value not in READERS:
            raise ValueError(f"no reader of {kind.value!r}; there are {', '.join(READERS)}")
        return AnalyzeResult(_row_schema(hint.value))

    def eval(self, blob, kind, hint):
        if blob is None:
            return
        fields = _row_schema(hint).fields[1:-1]
        try:
            for place, record in enumerate(_records(kind, blob)):
                yield (place, *[_fitted(record.get(f.name), f.dataType) for f in fields], None)
        except Exception as why:  # a damaged blob is a result, not the end of a job
            yield (-1, *[None] * len(fields), f"{type(why).__name__}: {why}"[:300])


def register(spark: SparkSession) -> None:
    spark.udtf.register("read_blob", ReadBlob)
