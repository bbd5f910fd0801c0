"""Aggregations: declarative ones that run inside the engine, and a contract for own ones."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import InvalidRequest, StateLimitExceeded, StateSerializationError
from weftline.session import ship

STATE_LIMIT = 8 << 20


@dataclass(frozen=True)
class Aggregate:
    """One aggregate over a column.  NaN counts as null; with ``ignore_nulls=False`` one null makes the result null."""

    on: str | None = None
    ignore_nulls: bool = True
    alias: str | None = None
    kind = ""

    @property
    def name(self) -> str:
        return self.alias or f"{self.kind}({self.on or ''})"

    def value(self, df: DataFrame) -> Column:
        c = F.col(self.on)
        return F.nanvl(c, F.lit(None).cast(df.schema[self.on].dataType)) if isinstance(df.schema[self.on].dataType, (T.FloatType, T.DoubleType)) else c

    def of(self, v: Column) -> Column:
        raise NotImplementedError

    def column(self, df: DataFrame) -> Column:
        if self.on is None or self.on not in df.columns:
            raise KeyError(f"no such column: {self.on}")
        v = self.value(df)
        out = self.of(v)
        if not self.ignore_nulls:
            out = F.when(F.coalesce(F.bool_or(v.isNull()), F.lit(False)), F.lit(None)).otherwise(out)
        return out.alias(self.name)


@dataclass(frozen=True)
class Count(Aggregate):
    """Rows, or values of a column; nulls count unless ``ignore_nulls`` is set."""

    ignore_nulls: bool = False
    kind = "count"

    def column(self, df: DataFrame) -> Column:
        if self.on is not None and self.on not in df.columns:
            raise KeyError(f"no such column: {self.on}")
        return F.count(self.value(df) if self.on and self.ignore_nulls else F.lit(1)).alias(self.name)


@dataclass(frozen=True)
class Sum(Aggregate):
    """Sum; ``wide`` adds whole numbers as decimals, which do not overflow."""

    wide: bool = False
    kind = "sum"

    def of(self, v: Column) -> Column:
        return F.sum(v.cast("decimal(38,0)") if self.wide else v)


@dataclass(frozen=True)
class Min(Aggregate):
    """The least value; ``zero`` makes what stands for no value at all, else null."""

    zero: Callable[[], Any] | None = None
    kind = "min"

    def of(self, v: Column) -> Column:
        return F.min(v) if self.zero is None else F.when(F.count(v) == 0, F.lit(self.zero())).otherwise(F.min(v))


@dataclass(frozen=True)
class Max(Aggregate):
    """The greatest value; ``zero`` makes what stands for no value at all, else null."""

    zero: Callable[[], Any] | None = None
    kind = "max"

    def of(self, v: Column) -> Column:
        return F.max(v) if self.zero is None else F.when(F.count(v) == 0, F.lit(self.zero())).otherwise(F.max(v))


@dataclass(frozen=True)
class Mean(Aggregate):
    kind = "mean"

    def of(self, v: Column) -> Column:
        return F.avg(v)


@dataclass(frozen=True)
class Std(Aggregate):
    """Standard deviation with ``ddof``; NaN where there are no more values than that."""

    ddof: int = 1
    kind = "std"

    def of(self, v: Column) -> Column:
        v = v.cast("double")
        n = F.count(v)
        return F.when(n == 0, F.lit(None)).when(n <= self.ddof, F.lit(float("nan"))).otherwise(F.sqrt(F.var_pop(v) * n / (n - self.ddof)))


@dataclass(frozen=True)
class AbsMax(Aggregate):
    kind = "abs_max"

    def of(self, v: Column) -> Column:
        return F.max(F.abs(v))


class AggregateFn:
    """An own aggregation: a zero, a step over a batch, an associative merge and an end.

    ``step(state, batch)`` gets an Arrow record batch.  States travel pickled
    and may not exceed ``STATE_LIMIT`` bytes.
    """

    def __init__(self, name: str, zero: Callable[[], Any], step: Callable[[Any, pa.RecordBatch], Any], merge: Callable[[Any, Any], Any], end: Callable[[Any], Any] = lambda s: s):
        self.name, self.zero, self.step, self.merge, self.end = name, zero, step, merge, end


def _dump(state: Any) -> bytes:
    try:
        data = pickle.dumps(state)
    except Exception as e:
        raise StateSerializationError(str(e)) from e
    if len(data) > STATE_LIMIT:
        raise StateLimitExceeded(f"a state of {len(data)} bytes; the limit is {STATE_LIMIT}")
    return data


def own_aggregates(df: DataFrame, fns: list[AggregateFn]) -> dict[str, Any]:
    """Run own aggregations: one state a partition, merged in two levels, the last few by the driver."""
    ship(df.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = [f.zero() for f in fns]
        seen = False
        for b in batches:
            seen = seen or b.num_rows > 0
            states = [f.step(s, b) for f, s in zip(fns, states)]
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([_dump(states)], pa.binary())], names=["state"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = None
        for b in batches:
            for data in b.column(0).to_pylist():
                one = pickle.loads(data)
                states = one if states is None else [f.merge(x, y) for f, x, y in zip(fns, states, one)]
        if states is not None:
            yield pa.RecordBatch.from_arrays([pa.array([_dump(states)], pa.binary())], names=["state"])

    first = df.mapInArrow(partial, "state binary")
    rows = first.repartition(8).mapInArrow(merged, "state binary").collect()  # at most eight states
    if not rows:
        return {}
    states = None
    for r in rows:
        one = pickle.loads(bytes(r["state"]))
        states = one if states is None else [f.merge(x, y) for f, x, y in zip(fns, states, one)]
    return {f.name: f.end(s) for f, s in zip(fns, states)}


def aggregate(df: DataFrame, *aggs: Aggregate | AggregateFn) -> dict[str, Any] | None:
    """All aggregates over the whole frame in one pass, as a dict; None over no rows."""
    names = [a.name for a in aggs]
    if not aggs or len(set(names)) != len(names):
        raise InvalidRequest(f"aggregates must be named, and each once: {names}")
    plain = [a for a in aggs if isinstance(a, Aggregate)]
    own = [a for a in aggs if isinstance(a, AggregateFn)]
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *[a.column(df) for a in plain]).first()
    if row["__rows"] == 0:
        return None
    found = {a.name: row[a.name] for a in plain} | (own_aggregates(df, own) if own else {})
    return {n: found[n] for n in names}


def aggregate_frame(df: DataFrame, *aggs: Aggregate, by: list[str] | None = None) -> DataFrame:
    """The same aggregates as a frame, optionally by key."""
    cols = [a.column(df) for a in aggs]
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)
