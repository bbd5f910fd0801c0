"""Keys: type families, and an order that is the same as that of their JSON text.

Two keys can be equal only within one family: whole numbers of any width match
each other, but never a floating number, a string or a boolean.  Null in any
key column matches nothing; null inside a list or struct is a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import InvalidRequest

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_BROKEN = (T.FloatType, T.DoubleType)


def family(kind: T.DataType) -> object:
    """A value that is equal for types whose keys may match."""
    if isinstance(kind, _WHOLE):
        return "whole"
    if isinstance(kind, _BROKEN):
        return "floating"
    if isinstance(kind, T.DecimalType):
        return "decimal"
    if isinstance(kind, T.ArrayType):
        return ("list", family(kind.elementType))
    if isinstance(kind, T.MapType):
        return ("map", family(kind.keyType), family(kind.valueType))
    if isinstance(kind, T.StructType):
        return ("struct", tuple(sorted((f.name, family(f.dataType)) for f in kind.fields)))
    return kind.typeName()


def comparable(column: Column, kind: T.DataType) -> Column:
    """The column in a form that can be joined and grouped: a map becomes its sorted entries."""
    return F.array_sort(F.map_entries(column)) if isinstance(kind, T.MapType) else column


def check_columns(df: DataFrame, names: list[str], what: str = "columns") -> list[str]:
    """The names, if they are given, distinct and present; else an error."""
    names = [names] if isinstance(names, str) else list(names)
    if not names or len(set(names)) != len(names):
        raise InvalidRequest(f"{what} must be named, and each once: {names}")
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"no such {what}: {missing}")
    return names


def equal_keys(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], strict: bool = False) -> Column:
    """The condition that all key pairs match; never true, or an error if ``strict``, for pairs of two families."""
    cond = F.lit(True)
    for a, b in pairs:
        ka, kb = left.schema[a].dataType, right.schema[b].dataType
        if family(ka) != family(kb):
            if strict:
                raise InvalidRequest(f"keys of two kinds: {a} {ka.simpleString()}, {b} {kb.simpleString()}")
            return F.lit(False)
        cond = cond & (comparable(left[a], ka) == comparable(right[b], kb))
    return cond


def json_order(df: DataFrame, names: list[str]) -> Column:
    """A sort key: the JSON text of the key columns, so that "10" comes before "2"."""
    return F.to_json(F.array(*[F.to_json(F.struct(F.col(n).alias("k"))) for n in names]))
