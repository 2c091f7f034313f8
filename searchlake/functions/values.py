"""Coercion between value types, JSON rendering and flattening, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidParam
from ..types import FieldType


def coerce(value: Column, source: T.DataType, target: FieldType) -> Column:
    """A value as a field's type; what cannot be one is null, so that it is not indexed."""
    if isinstance(source, T.ArrayType):
        if target is FieldType.VECTOR:
            return value.cast("array<float>")
        return F.transform(value, lambda x: coerce(x, source.elementType, target))
    text, boolean = isinstance(source, T.StringType), isinstance(source, T.BooleanType)
    if target is FieldType.BOOL:
        if text:
            return F.when(value.isin("true", "false"), value == "true")
        return value if boolean else value != 0
    if target is FieldType.INT:
        if text:
            return F.when(value.rlike(r"^[+-]?[0-9]+$"), value.try_cast("bigint"))
        return value.try_cast("bigint")
    if target is FieldType.FLOAT:
        return value.cast("int").cast("float") if boolean else value.try_cast("float")
    if target in (FieldType.STRING, FieldType.TEXT):
        return value.cast("string")
    raise InvalidParam(f"no coercion of {source.simpleString()} to {target.value}")


def literal(text: str, target: FieldType):
    """A literal of a query as a Python value of a field's type; raises where it is none."""
    try:
        if target is FieldType.BOOL:
            return {"true": True, "false": False}[str(text).lower()]
        if target is FieldType.INT:
            return int(text)
        if target is FieldType.FLOAT:
            return float(text)
    except (KeyError, ValueError):
        raise InvalidParam(f"{text!r} is no {target.value}") from None
    return str(text)


def json_text(document: Column, path: str) -> Column:
    """A JSON value as text: null and missing are empty, elements of a list are joined by commas, objects stay JSON."""
    raw = F.get_json_object(document, path)
    parts = F.from_json(raw, "array<string>")
    listed = F.when(F.ltrim(raw).startswith("["), F.array_join(F.transform(parts, lambda x: F.coalesce(x, F.lit(""))), ","))
    return F.coalesce(listed, raw, F.lit(""))


def flatten_deep(value: Column, source: T.DataType) -> Column:
    """Nested lists as one list of scalars."""
    while isinstance(source, T.ArrayType) and isinstance(source.elementType, T.ArrayType):
        value, source = F.flatten(value), source.elementType
    return value
