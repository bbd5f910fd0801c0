"""Python callbacks over rows and batches, under a declared schema.

Column expressions and SQL strings stay inside the JVM; a Python function is
the way out and runs over Arrow batches.  Without ``schema`` the function is
run over a bounded sample and the types found are fixed; later rows that do
not fit fail.
"""

from __future__ import annotations

import asyncio
import copy
import inspect
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from weftline.errors import InvalidRequest
from weftline.operators.keys import check_columns
from weftline.session import ship

SAMPLE_ROWS = 100
BATCH = 256
FORMATS = ("default", "numpy", "pandas", "pyarrow")
_FORBIDDEN = {"row", "raw", "record", "_row"}


def ready(fn: Any, args: tuple = (), kwargs: dict | None = None) -> Callable:
    """A function as it is; a class built once a worker; an instance as its own copy."""
    if inspect.isclass(fn):
        return fn(*args, **(kwargs or {}))
    return fn if inspect.isroutine(fn) or not hasattr(fn, "__dict__") else copy.deepcopy(fn)


def _schema(df: DataFrame, schema: Any, sample: Callable[[list[dict]], list[dict]]) -> tuple[Any, pa.Schema]:
    if schema is None:
        rows = sample([r.asDict(recursive=True) for r in df.limit(SAMPLE_ROWS).collect()])
        if not rows:
            raise InvalidRequest("no schema, and no row to infer one from")
        found = pa.Table.from_pylist(rows).schema
        return from_arrow_schema(found), to_arrow_schema(from_arrow_schema(found))
    kind = df.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    return kind, to_arrow_schema(kind)


def _over_rows(df: DataFrame, fn: Any, args: tuple, kwargs: dict | None, schema: Any, many: Callable[[Callable, dict], Iterable[dict]]) -> DataFrame:
    ship(df.sparkSession)
    kind, target = _schema(df, schema, lambda rows: [x for r in rows for x in many(ready(fn, args, kwargs), r)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = ready(fn, args, kwargs)
        for b in batches:
            rows = [x for r in b.to_pylist() for x in many(call, r)]
            for x in rows:
                extra = x.keys() - set(target.names)
                if extra:
                    raise InvalidRequest(f"fields outside the schema: {sorted(extra)}")
            yield from pa.Table.from_pylist(rows, schema=target).to_batches()

    return df.mapInArrow(run, kind)


def map_rows(df: DataFrame, fn: Any, schema: Any = None, args: tuple = (), kwargs: dict | None = None, catch: tuple[type[BaseException], ...] = (), missed: Any = None) -> DataFrame:
    """Replace each row by the mapping that ``fn(row)`` returns; errors of the types in ``catch`` drop the row.

    ``missed``, an accumulator of the Spark context, counts the rows that are dropped (again where a task is run again).
    """

    def one(call: Callable, row: dict) -> Iterable[dict]:
        try:
            out = call(row)
        except catch:
            if missed is not None:
                missed.add(1)
            return []
        if not isinstance(out, dict):
            raise InvalidRequest("a row function must return a mapping")
        return [out]

    return _over_rows(df, fn, args, kwargs, schema, one)


def flat_map_rows(df: DataFrame, fn: Any, schema: Any = None, args: tuple = (), kwargs: dict | None = None) -> DataFrame:
    """Any number of mappings for each row."""

    def some(call: Callable, row: dict) -> Iterable[dict]:
        out = call(row)
        if isinstance(out, dict):
            raise InvalidRequest("a flat map must return several mappings, not one")
        return out

    return _over_rows(df, fn, args, kwargs, schema, some)


def _bound(df: DataFrame, fn: Any, inputs: list[str]) -> list[str]:
    names = check_columns(df, inputs, "inputs")
    target = fn.__init__ if inspect.isclass(fn) else fn
    if not inspect.isclass(fn):
        params = inspect.signature(target).parameters
        if any(p.kind in (p.VAR_POSITIONAL, p.VAR_KEYWORD) for p in params.values()) or _FORBIDDEN & set(params):
            raise InvalidRequest("a bound function takes its columns by plain parameters")
        if len(params) < len(names):
            raise InvalidRequest(f"{len(names)} inputs, {len(params)} parameters")
    return names


def map_bound(df: DataFrame, fn: Any, inputs: list[str], output: str | None = None, outputs: list[str] | None = None, returns: Any = "string", args: tuple = (), kwargs: dict | None = None) -> DataFrame:
    """Call ``fn`` with the input columns as arguments and add its result; the other columns stay in the JVM.

    ``output`` names one column of type ``returns``; ``outputs`` several, with
    ``returns`` their struct type.  With neither, the function must return None.
    """
    ship(df.sparkSession)
    names = _bound(df, fn, inputs)
    if output and outputs:
        raise InvalidRequest("output or outputs, not both")
    kind = df.sparkSession.createDataFrame([], f"x {returns}").schema["x"].dataType if isinstance(returns, str) else returns
    target = to_arrow_schema(df.sparkSession.createDataFrame([], "x int").schema.add("y", kind)).field("y").type
    silent = not output and not outputs

    @F.arrow_udf(returnType="boolean" if silent else kind)
    def call(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        f = ready(fn, args, kwargs)
        for cols in parts:
            got = [f(*x) for x in zip(*(c.to_pylist() for c in cols[1:]))]
            if silent:
                if any(x is not None for x in got):
                    raise InvalidRequest("a result, but no output to put it in")
                yield pa.array([True] * len(got), pa.bool_())
            else:
                yield pa.array(got, target)

    value = call(F.lit(True), *[F.col(n) for n in names])  # several arguments always
    if silent:
        return df.where(value)
    if output:
        return df.withColumn(output, value)
    out = df.withColumn("__out", value)
    return out.select(*[c for c in df.columns if c not in outputs], *[F.col(f"__out.{n}").alias(n) for n in outputs])


def filter_rows(df: DataFrame, fn: Any) -> DataFrame:
    """A Column or SQL string is pushed down; a Python predicate runs over batches and keeps rows where it is true."""
    if isinstance(fn, (str, Column)):
        return df.where(fn)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = ready(fn)
        for b in batches:
            yield b.filter(pa.array([bool(call(r)) for r in b.to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def as_format(table: pa.Table, form: str) -> Any:
    """A batch as the callback wants it: a dict of arrays (default, numpy), a pandas frame or an Arrow table."""
    if form == "pandas":
        return table.to_pandas()
    if form == "pyarrow":
        return table
    return {n: table[n].to_numpy(zero_copy_only=False) for n in table.column_names}


def to_table(value: Any, target: pa.Schema | None = None) -> pa.Table:
    """A callback's result as an Arrow table of the target schema."""
    if isinstance(value, pa.RecordBatch):
        value = pa.Table.from_batches([value])
    elif isinstance(value, dict):
        value = pa.table({k: pa.array(list(v) if not isinstance(v, pa.Array) and getattr(v, "ndim", 1) > 1 else v) for k, v in value.items()})
    elif not isinstance(value, pa.Table):
        value = pa.Table.from_pandas(value, preserve_index=False)
    return value.select(target.names).cast(target) if target is not None else value


def rechunk(batches: Iterator[pa.RecordBatch], size: int | None, drop_last: bool = False) -> Iterator[pa.Table]:
    """Batches of exactly ``size`` rows; the last may be smaller."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if size is None:
            if b.num_rows:
                yield pa.Table.from_batches([b])
            continue
        while b.num_rows:
            part = b.slice(0, size - n)
            held.append(part)
            n += part.num_rows
            b = b.slice(part.num_rows)
            if n == size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n and not drop_last:
        yield pa.Table.from_batches(held)


def map_batches(df: DataFrame, fn: Any, schema: Any = None, batch_size: int | None = BATCH, batch_format: str = "default", args: tuple = (), kwargs: dict | None = None, whole: bool = False) -> DataFrame:
    """A function from batch to batch, or to several batches.

    Batches have ``batch_size`` rows, the last of a partition fewer; with
    ``whole`` the boundaries run over the whole frame in one partition.
    """
    if batch_format not in FORMATS:
        raise InvalidRequest(f"batch_format must be one of {FORMATS}")
    ship(df.sparkSession)

    def results(call: Callable, table: pa.Table) -> Iterator[Any]:
        out = call(as_format(table, batch_format))
        yield from out if inspect.isgenerator(out) else [out]

    def sample(rows: list[dict]) -> list[dict]:
        t = pa.Table.from_pylist(rows, schema=to_arrow_schema(df.schema)) if rows else None
        return [r for x in results(ready(fn, args, kwargs), t) for r in to_table(x).to_pylist()] if t is not None else []

    kind, target = _schema(df, schema, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = ready(fn, args, kwargs)
        for table in rechunk(batches, batch_size):
            for out in results(call, table):
                yield from to_table(out, target).to_batches()

    return (df.coalesce(1) if whole else df).mapInArrow(run, kind)


def add_column(df: DataFrame, name: str, value: Any, returns: Any = "double") -> DataFrame:
    """A Column, or a function from a pandas frame to a column of equal length; a column of that name is replaced."""
    if isinstance(value, Column):
        return df.withColumn(name, value)
    ship(df.sparkSession)
    kind = df.sparkSession.createDataFrame([], f"x {returns}").schema["x"].dataType if isinstance(returns, str) else returns
    schema = df.drop(name).withColumn(name, F.lit(None).cast(kind)).schema
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            frame = b.to_pandas()
            got = value(frame)
            if len(got) != len(frame):
                raise InvalidRequest(f"{len(got)} values for {len(frame)} rows")
            frame[name] = list(got)
            yield from to_table(frame, target).to_batches()

    return df.mapInArrow(run, schema)


def map_async(df: DataFrame, fn: Any, schema: Any, concurrency: int = 16, catch: tuple[type[BaseException], ...] = (), args: tuple = (), kwargs: dict | None = None, timeout: float | None = None) -> DataFrame:
    """Row by row with at most ``concurrency`` calls at once in each task, in any order.

    ``fn`` may be a coroutine or a plain function (run in threads); it returns a
    mapping, None (the row is dropped) or a list (several rows).  An object with
    ``astart``, ``astop`` or ``aclose`` is started and ended around a partition.
    """
    ship(df.sparkSession)
    kind, target = _schema(df, schema, lambda rows: [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = ready(fn, args, kwargs)
        loop = asyncio.new_event_loop()
        pool = ThreadPoolExecutor(concurrency)
        coroutine = inspect.iscoroutinefunction(call) or inspect.iscoroutinefunction(getattr(call, "__call__", None))

        async def hook(name: str) -> None:
            if hasattr(call, name):
                await getattr(call, name)()

        async def over(rows: list[dict]) -> list[dict]:
            gate = asyncio.Semaphore(concurrency)
            out: list[dict] = []

            async def one(row: dict) -> None:
                async with gate:
                    try:
                        work = call(row) if coroutine else loop.run_in_executor(pool, call, row)
                        got = await (asyncio.wait_for(work, timeout) if timeout else work)
                    except catch:
                        return
                    out.extend([] if got is None else got if isinstance(got, list) else [got])

            await asyncio.gather(*map(one, rows))
            return out

        try:
            loop.run_until_complete(hook("astart"))
            for b in batches:
                rows = loop.run_until_complete(over(b.to_pylist()))
                yield from pa.Table.from_pylist(rows, schema=target).to_batches()
            loop.run_until_complete(hook("astop"))
        finally:
            loop.run_until_complete(hook("aclose"))
            pool.shutdown()
            loop.close()

    return df.mapInArrow(run, kind)


def batch_map(df: DataFrame, fn: Any, schema: Any, max_batch: int = 32, batch_format: str = "default", failed: str | None = None) -> DataFrame:
    """Micro-batches of at most ``max_batch`` rows; with ``failed`` a batch whose call fails gives one row with the error in that column."""
    ship(df.sparkSession)
    kind, _ = _schema(df, schema, lambda rows: [])
    if failed:
        kind = df.sparkSession.createDataFrame([], kind).withColumn(failed, F.lit(None).cast("string")).schema
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = ready(fn)
        for table in rechunk(batches, max_batch):
            try:
                out = to_table(call(as_format(table, batch_format)))
            except Exception as e:
                if not failed:
                    raise
                out = pa.table({failed: pa.array([f"{type(e).__name__}: {e}"])})
            for f in target:
                if f.name not in out.column_names:
                    out = out.append_column(f.name, pa.nulls(out.num_rows, f.type))
            yield from out.select(target.names).cast(target).to_batches()

    return df.mapInArrow(run, kind)
