"""Writers: files, own sinks and checkpoints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import InvalidRequest
from weftline.session import ship
from weftline.snapshot.table import Receipt, VersionedTable


def write_parquet(df: DataFrame, path: str, single: bool = False, mode: str = "overwrite", by: list[str] | None = None) -> None:
    w = (df.coalesce(1) if single else df).write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def write_json(df: DataFrame, path: str, single: bool = False, mode: str = "overwrite") -> None:
    """JSON lines; NaN and infinities are refused, as JSON has none."""
    bad = F.lit(False)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            d = F.col(f.name).cast("double")
            bad = bad | F.coalesce(F.isnan(d) | (F.abs(d) == float("inf")), F.lit(False))
    guarded = df.where(F.when(bad, F.raise_error(F.lit("NaN or infinity in JSON"))).otherwise(F.lit(True)))
    (guarded.coalesce(1) if single else guarded).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, single: bool = False, mode: str = "overwrite", sep: str = ",") -> None:
    (df.coalesce(1) if single else df).write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').option("emptyValue", "").csv(path)


@dataclass(frozen=True)
class WriteResult:
    """What one task of a sink wrote."""

    partition: int
    rows: int
    value: Any = None


class Sink:
    """The contract of an own sink: start, write the blocks of each task, then complete or fail as a whole."""

    def on_write_start(self) -> None: ...

    def write(self, blocks: Iterator[pa.RecordBatch], partition: int) -> Any:
        raise NotImplementedError

    def on_write_complete(self, results: list[WriteResult]) -> Any:
        return results

    def on_write_failed(self, error: Exception) -> None: ...


def write_datasink(df: DataFrame, sink: Sink) -> Any:
    """Run a sink: its ``write`` once a partition, on the executors; only the small results come back."""
    import pickle

    ship(df.sparkSession)
    sink.on_write_start()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal count
            for b in batches:
                count += b.num_rows
                yield b

        value = sink.write(counted(), part)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([count], pa.int64()), pa.array([pickle.dumps(value)], pa.binary())], names=["partition", "rows", "value"])

    try:
        rows = df.mapInArrow(run, "partition int, rows long, value binary").collect()  # one row a partition
        return sink.on_write_complete([WriteResult(r["partition"], r["rows"], pickle.loads(bytes(r["value"]))) for r in sorted(rows, key=lambda r: r["partition"])])
    except Exception as e:
        sink.on_write_failed(e)
        raise


class KeyValueSink(Sink):
    """Keys and values into a versioned table: a later put replaces the values of its keys."""

    def __init__(self, table: VersionedTable):
        self.table = table

    def put(self, df: DataFrame, key: str = "key", value: str = "value", order: str | None = None) -> Receipt:
        """Of rows with one key the last by ``order`` counts; without it the keys must be unique."""
        rows = df.select(F.col(key).alias("key"), F.col(value).alias("value"), (F.col(order) if order else F.lit(0)).alias("at"))
        if order is None and not rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            raise InvalidRequest("repeated keys: name the column that orders them")
        rows = rows.groupBy("key").agg(F.max_by("value", F.struct("at", "value")).alias("value"))
        if not self.table.head():
            return self.table.commit(rows, "create")
        return self.table.merge(rows, ["key"], when_not_matched="insert")


def checkpoint(df: DataFrame, path: str, version: str) -> DataFrame:
    """A snapshot that is written once and read again as long as ``version`` is the same; another version is an error."""
    return checkpoint_table(df, VersionedTable(df.sparkSession, path), version)


def checkpoint_table(df: DataFrame, table: VersionedTable, fingerprint: str) -> DataFrame:
    """The same in a versioned table: a finished version carries the fingerprint, so half a write is never taken for one."""
    head = table.head()
    if head:
        held = table.manifest(head).keys.get("fingerprint")
        if held != fingerprint:
            raise InvalidRequest(f"the checkpoint was made for {held!r}, not {fingerprint!r}")
        return table.read(head)
    table.commit(df, "create", keys={"fingerprint": fingerprint})
    return table.read(1)


def plan_fingerprint(df: DataFrame, *more: str) -> str:
    """A fingerprint of what a frame is to compute: its optimised plan without expression ids."""
    import re

    text = re.sub(r"#\d+L?", "", df._jdf.queryExecution().optimizedPlan().toString())
    return hashlib.sha256("\x00".join([text, *more]).encode()).hexdigest()


def scan_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows of each key in a manifest."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def checkpoint_filter(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the finished ones; rows without a key are kept."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def table_of(spark: SparkSession, uri: str) -> VersionedTable:
    return VersionedTable(spark, uri)
