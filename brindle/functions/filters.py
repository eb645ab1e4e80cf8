"""Filters: nested ``{op, field, value, sub}`` compiled to two-valued Columns.

``all`` (or empty), ``eq``, ``and``, ``or``; an unknown operator matches nothing. Numbers compare as doubles
with numbers only; null equals a present null; a missing field equals nothing.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

_log = logging.getLogger(__name__)
_NUMERIC = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def parse(text: str) -> dict:
    return json.loads(text)


def typed_field(df: DataFrame) -> Callable[[str, object], Column]:
    """Fields are columns; their types decide at once what can be equal. A null cell is a missing field."""

    def equals(field: str, value: object) -> Column:
        if field not in df.columns or value is None:
            return F.lit(False)
        kind, column = df.schema[field].dataType, F.col(f"`{field}`")
        if isinstance(value, bool):
            return column == value if isinstance(kind, BooleanType) else F.lit(False)
        if isinstance(value, (int, float)):
            return column == value if isinstance(kind, NumericType) else F.lit(False)
        return column == value if isinstance(kind, StringType) and isinstance(value, str) else F.lit(False)

    return equals


def variant_field(attributes: Column) -> Callable[[str, object], Column]:
    """Fields are paths of a VARIANT; its own type is looked at first, since a cast would turn "5" into 5."""

    def equals(field: str, value: object) -> Column:
        path = "$['" + field.replace("'", "\\'") + "']"
        v = F.try_variant_get(attributes, path, "variant")
        kind = F.schema_of_variant(v)
        if value is None:
            return F.is_variant_null(v)
        if isinstance(value, bool):
            return (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == value)
        if isinstance(value, (int, float)):
            return kind.rlike(_NUMERIC) & (F.try_variant_get(v, "$", "double") == float(value))
        if isinstance(value, str):
            return (kind == "STRING") & (F.try_variant_get(v, "$", "string") == value)
        return F.to_json(v) == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    return equals


def compile_filter(spec: dict | None, equals: Callable[[str, object], Column]) -> Column:
    """A Column that is true or false, never null."""
    op = (spec or {}).get("op", "")
    if op in ("", "all"):
        return F.lit(True)
    if op == "eq":
        return F.coalesce(equals(spec["field"], spec.get("value")), F.lit(False))
    parts = [compile_filter(s, equals) for s in spec.get("sub") or []]
    if op == "and":
        return reduce(Column.__and__, parts, F.lit(True))
    if op == "or":
        return reduce(Column.__or__, parts, F.lit(False))
    _log.warning("filter operator %r is unknown and matches nothing", op)
    return F.lit(False)


def value_key(column: Column, kind: object) -> Column | None:
    """The key of a scalar in the attribute index: its kind and its text, -0 as 0; None for other types."""
    if isinstance(kind, BooleanType):
        return F.concat(F.lit("b:"), column.cast("string"))
    if isinstance(kind, NumericType):
        return F.concat(F.lit("n:"), (column.cast("double") + F.lit(0.0)).cast("string"))
    if isinstance(kind, StringType):
        return F.concat(F.lit("s:"), column)
    return None


def variant_key(v: Column) -> Column:
    """The same key of a VARIANT; null for other types."""
    kind = F.schema_of_variant(v)
    return (
        F.when(F.is_variant_null(v), F.lit("z:"))
        .when(kind == "BOOLEAN", F.concat(F.lit("b:"), F.try_variant_get(v, "$", "string")))
        .when(kind.rlike(_NUMERIC), F.concat(F.lit("n:"), (F.try_variant_get(v, "$", "double") + F.lit(0.0)).cast("string")))
        .when(kind == "STRING", F.concat(F.lit("s:"), F.try_variant_get(v, "$", "string")))
    )


def literal_key(value: object) -> Column | None:
    """The same key of a filter's value; None if no scalar."""
    if value is None:
        return F.lit("z:")
    if isinstance(value, bool):
        return F.lit(f"b:{str(value).lower()}")
    if isinstance(value, (int, float)):
        return F.concat(F.lit("n:"), (F.lit(float(value)) + F.lit(0.0)).cast("string"))
    return F.lit(f"s:{value}") if isinstance(value, str) else None
