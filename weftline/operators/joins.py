"""Equality joins with the column rules of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.errors import InvalidRequest
from weftline.operators.keys import check_columns, comparable, equal_keys, family

HOWS = {"inner": "inner", "left": "left", "semi": "left_semi", "anti": "left_anti"}


def join(left: DataFrame, right: DataFrame, on, right_on=None, how: str = "inner", suffix: str = "_right", strict: bool = False, presence: str | None = None) -> DataFrame:
    """Join on equal keys; ``how`` is inner, left, semi or anti.

    A key of one name on both sides is kept once; any other column of the
    right side whose name is taken gets ``suffix``, and it is an error if that
    name is taken too.  Null keys never match (an anti join keeps such rows).
    ``presence`` names a boolean column that tells, for a left join, whether a
    row found a partner: only so an absent field differs from a null one.
    The strategy is left to the planner: no side is broadcast by a hint.
    """
    if how not in HOWS:
        raise InvalidRequest(f"how must be one of {sorted(HOWS)}")
    keys = check_columns(left, on, "left keys")
    other = check_columns(right, right_on if right_on is not None else on, "right keys")
    if len(keys) != len(other):
        raise InvalidRequest("left and right keys differ in number")
    merged = {b for a, b in zip(keys, other) if a == b}
    names: dict[str, str] = {}
    taken = set(left.columns)
    for c in right.columns:
        if c in merged:
            continue
        name = c + suffix if c in taken else c
        if name in taken:
            raise InvalidRequest(f"column {c!r} of the right side clashes, and so does {name!r}")
        names[c] = name
        taken.add(name)
    a = left.alias("__a")
    b = right.select([F.col(c).alias(f"__b_{i}") for i, c in enumerate(right.columns)] + ([F.lit(True).alias("__hit")] if presence else []))
    place = {c: f"__b_{i}" for i, c in enumerate(right.columns)}
    cond = F.lit(True)
    for x, y in zip(keys, other):
        kx, ky = left.schema[x].dataType, right.schema[y].dataType
        if family(kx) != family(ky):
            cond = equal_keys(left, right, [(x, y)], strict)
            break
        cond = cond & (comparable(F.col(f"__a.{_quoted(x)}"), kx) == comparable(F.col(place[y]), ky))
    out = a.join(b, cond, HOWS[how])
    if how in ("semi", "anti"):
        return out.select([F.col(f"__a.{_quoted(c)}") for c in left.columns])
    cols = [F.col(f"__a.{_quoted(c)}") for c in left.columns] + [F.col(place[c]).alias(n) for c, n in names.items()]
    return out.select(cols + ([F.coalesce("__hit", F.lit(False)).alias(presence)] if presence else []))


def exclude_keys(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """Rows whose key does not occur in ``other``: only the distinct keys of the other side are moved."""
    keys = check_columns(df, on, "keys")
    check_columns(other, keys, "keys")
    return join(df, other.select(*keys).distinct(), keys, how="anti")


def union(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; missing columns are null, and a column must have one type throughout."""
    if not frames:
        raise InvalidRequest("nothing to unite")
    kinds: dict[str, str] = {}
    for f in frames:
        for field in f.schema.fields:
            kind = field.dataType.simpleString()
            if kinds.setdefault(field.name, kind) != kind and "void" not in (kind, kinds[field.name]):
                raise InvalidRequest(f"column {field.name!r} has two types: {kinds[field.name]}, {kind}")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def prepend(df: DataFrame, other: DataFrame, max_rows: int, order: str = "__rank") -> DataFrame:
    """``other`` ahead of ``df``; an error if it has more than ``max_rows`` rows.  ``order`` is 0 for the rows ahead."""
    n = other.limit(max_rows + 1).count()
    if n > max_rows:
        raise InvalidRequest(f"more than {max_rows} rows to prepend")
    return union(other.withColumn(order, F.lit(0)), df.withColumn(order, F.lit(1)))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
