"""Work on all rows of a key: folds and ordered batches."""

from __future__ import annotations

import copy
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.errors import InvalidRequest
from weftline.operators.keys import check_columns
from weftline.operators.ranking import ordered_rank
from weftline.session import ship


def reduce_columns(df: DataFrame, on, aggregates: dict[str, Column]) -> DataFrame:
    """A fold that is an aggregate (count, sum, first or last by an order, ...): combined before the shuffle."""
    return df.groupBy(*check_columns(df, on, "keys")).agg(*[c.alias(n) for n, c in aggregates.items()])


def first_by(value: str, order: str) -> Column:
    """The value of the first row of a key; an aggregate, so no sort."""
    return F.min_by(value, order)


def last_by(value: str, order: str) -> Column:
    return F.max_by(value, order)


def fold_columns(df: DataFrame, on, order: str, fields: list[str], start: Column, step: Callable[[Column, Column], Column], end: Callable[[Column], Column] | None = None, output: str = "state") -> DataFrame:
    """An ordered fold whose step is an expression: runs on sorted arrays inside the JVM.

    The rows of one key form one array, as the fold needs them in order.
    """
    keys = check_columns(df, on, "keys")
    items = F.array_sort(F.collect_list(F.struct(F.col(order), *[F.col(f) for f in fields if f != order])))
    grouped = df.groupBy(*keys).agg(items.alias("__items"))
    folded = F.aggregate("__items", start, step, end) if end else F.aggregate("__items", start, step)
    return grouped.select(*keys, folded.alias(output))


def reduce_by_key(df: DataFrame, on, reducer: Callable[[Any, dict], Any], schema: str, initial: Any = None, order: list[str] | None = None, combine: Callable[[Any, Any], Any] | None = None, parts: int = 64) -> DataFrame:
    """A left fold of Python code over the rows of each key, in ``order``.

    ``reducer(state, row)`` starts from a copy of ``initial``; a key whose state
    ends as None gives no row, any other state must be a dict with the fields
    of ``schema``.  A fold that is not associative needs the rows of a key in
    sequence, in one task.  With ``combine(a, b)`` the fold is associative: hot
    keys are split into ``parts`` pieces, folded apart, and the few states merged
    in the order of the pieces.
    """
    ship(df.sparkSession)
    keys = check_columns(df, on, "keys")
    order = list(order or [])
    target = _arrow_schema(df, schema)

    def rows_of(t: pa.Table) -> list[dict]:
        return (t.sort_by([(o, "ascending") for o in order]) if order else t).to_pylist()

    def fold(t: pa.Table, drop: tuple = ()) -> Any:
        state = copy.deepcopy(initial)
        for row in rows_of(t.drop_columns(list(drop)) if drop else t):
            state = reducer(state, row)
        return state

    if combine is None:

        def run(t: pa.Table) -> pa.Table:
            state = fold(t)
            return pa.Table.from_pylist([state] if state is not None else [], schema=target)

        return df.groupBy(*keys).applyInArrow(run, schema)
    import pickle

    by = order or [c for c in df.columns if c not in keys]
    piece = F.pmod(F.xxhash64(*by), F.lit(parts))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields]

    def run_piece(t: pa.Table) -> pa.Table:
        state = pickle.dumps(fold(t, ("__piece",)))
        return pa.table({**{k: t[k].slice(0, 1) for k in keys}, "__piece": t["__piece"].slice(0, 1), "__state": pa.array([state], pa.binary())})

    def run_merge(t: pa.Table) -> pa.Table:
        state = None
        for data in t.sort_by("__piece")["__state"].to_pylist():
            one = pickle.loads(data)
            state = one if state is None else combine(state, one)
        return pa.Table.from_pylist([state] if state is not None else [], schema=target)

    states = df.withColumn("__piece", piece).groupBy(*keys, "__piece").applyInArrow(run_piece, ", ".join([*kept, "__piece long", "__state binary"]))
    return states.groupBy(*keys).applyInArrow(run_merge, schema)


def group_batches(df: DataFrame, on, max_rows: int = 32, order: list[str] | None = None, output: str = "items") -> DataFrame:
    """Ordered chunks of at most ``max_rows`` rows of each key: keys, items, group_index and group_last.

    Positions come from :func:`ordered_rank`, so a hot key is never gathered:
    only the rows of one chunk meet in one task.
    """
    keys = check_columns(df, on, "keys")
    if max_rows < 1:
        raise InvalidRequest("max_rows must be positive")
    if output in keys or output in ("group_index", "group_last") or {"group_index", "group_last"} & set(keys):
        raise InvalidRequest(f"reserved name: {output}")
    order = list(order or [c for c in df.columns if c not in keys])
    ranked = ordered_rank(df, keys, order, "__rank", total="__total")
    chunk = F.floor((F.col("__rank") - 1) / max_rows).cast("long")
    last = F.floor((F.col("__total") - 1) / max_rows).cast("long")
    item = F.struct(F.col("__rank"), F.struct(*df.columns).alias("row"))
    return (
        ranked.select(*keys, chunk.alias("group_index"), (chunk == last).alias("group_last"), item.alias("__item"))
        .groupBy(*keys, "group_index", "group_last")
        .agg(F.transform(F.array_sort(F.collect_list("__item")), lambda x: x["row"]).alias(output))
        .select(*keys, output, "group_index", "group_last")
    )


def _arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
