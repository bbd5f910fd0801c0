"""Readers and in-memory sources; each gives a plain DataFrame and reads nothing before an action."""

from __future__ import annotations

import sqlite3
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weftline.errors import InvalidRequest, UnsupportedSource
from weftline.operators.vectors import nearest
from weftline.session import get_spark, ship
from weftline.snapshot.table import VersionedTable


def from_items(rows: list, schema: Any = None, spark: SparkSession | None = None) -> DataFrame:
    """A list of dicts; other values become the column ``item``.  Iterators are rejected: see :func:`from_iter`."""
    spark = spark or get_spark()
    if not isinstance(rows, list):
        raise InvalidRequest("from_items takes a list")
    rows = [r if isinstance(r, dict) else {"item": r} for r in rows]
    if schema is not None:
        return spark.createDataFrame([tuple(r.get(n) for n in _names(spark, schema)) for r in rows], schema)
    if not rows:
        raise InvalidRequest("an empty list needs a schema")
    names = list(dict.fromkeys(k for r in rows for k in r))
    return spark.createDataFrame(pa.Table.from_pylist([{n: r.get(n) for n in names} for r in rows]))


def _names(spark: SparkSession, schema: Any) -> list[str]:
    return (spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema).names


def from_iter(factory: Callable[[], Iterable[dict]], schema: str, spark: SparkSession | None = None, batch: int = 1024) -> DataFrame:
    """Rows of an iterator that ``factory`` makes anew for every action, read in one task as they come."""
    spark = ship(spark or get_spark())
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            held: list[dict] = []
            for row in factory():
                held.append(row)
                if len(held) == batch:
                    yield from pa.Table.from_pylist(held, schema=target).to_batches()
                    held = []
            yield from pa.Table.from_pylist(held, schema=target).to_batches()

    return spark.range(0, 1, 1, 1).mapInArrow(run, schema)


def range_(n: int, spark: SparkSession | None = None) -> DataFrame:
    return (spark or get_spark()).range(n)


def from_arrow(tables: pa.Table | bytes | list, spark: SparkSession | None = None) -> DataFrame:
    """Arrow tables or IPC streams."""
    tables = tables if isinstance(tables, list) else [tables]
    tables = [pa.ipc.open_stream(t).read_all() if isinstance(t, (bytes, bytearray)) else t for t in tables]
    return (spark or get_spark()).createDataFrame(pa.concat_tables(tables))


def from_numpy(arrays: np.ndarray | list[np.ndarray], spark: SparkSession | None = None) -> DataFrame:
    """Items of arrays as column ``data``; an item with dimensions becomes a list."""
    arrays = arrays if isinstance(arrays, list) else [arrays]
    return (spark or get_spark()).createDataFrame(pa.table({"data": pa.array([x.tolist() for a in arrays for x in a])}))


def from_pandas(frames: pd.DataFrame | list[pd.DataFrame], spark: SparkSession | None = None) -> DataFrame:
    frames = frames if isinstance(frames, list) else [frames]
    return (spark or get_spark()).createDataFrame(pd.concat(frames, ignore_index=True))


def _paths(paths: str | list[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _with_path(df: DataFrame, include: bool) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias("path")) if include else df


def read_parquet(paths: str | list[str], columns: list[str] | None = None, where: str | Column | None = None, include_paths: bool = False, spark: SparkSession | None = None) -> DataFrame:
    df = _with_path((spark or get_spark()).read.parquet(*_paths(paths)), include_paths)
    df = df.where(where) if where is not None else df
    return df.select(*columns, *(["path"] if include_paths else [])) if columns else df


def read_json(paths: str | list[str], lines: bool = True, schema: Any = None, include_paths: bool = False, spark: SparkSession | None = None) -> DataFrame:
    r = (spark or get_spark()).read.option("multiLine", not lines)
    return _with_path((r.schema(schema) if schema else r).json(_paths(paths)), include_paths)


def read_csv(paths: str | list[str], schema: Any = None, sep: str = ",", quote: str = '"', header: bool = True, include_paths: bool = False, infer: bool = False, spark: SparkSession | None = None) -> DataFrame:
    """CSV with a header; all columns are strings unless a schema is given, and an empty field is '' and not null."""
    r = (spark or get_spark()).read.option("header", header).option("sep", sep).option("quote", quote).option("escape", quote).option("multiLine", True)
    if infer:
        return _with_path(r.option("inferSchema", True).csv(_paths(paths)), include_paths)
    df = _with_path((r.schema(schema) if schema else r).csv(_paths(paths)), include_paths)
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    return df if schema else df.fillna("")


def read_text(paths: str | list[str], encoding: str = "utf-8", drop_empty_lines: bool = True, include_paths: bool = False, spark: SparkSession | None = None) -> DataFrame:
    """One row a line, column ``text``."""
    spark = spark or get_spark()
    if encoding.lower().replace("-", "") == "utf8":
        df = _with_path(spark.read.text(_paths(paths)), include_paths).withColumnRenamed("value", "text")
    else:
        whole = spark.read.format("binaryFile").load(_paths(paths)).select("path", F.decode("content", encoding).alias("t"))
        df = whole.select(F.explode(F.split(F.regexp_replace("t", r"\r?\n$", ""), r"\r?\n")).alias("text"), *(["path"] if include_paths else []))
    return df.where(F.length("text") > 0) if drop_empty_lines else df


def read_binary_files(paths: str | list[str], include_paths: bool = False, spark: SparkSession | None = None) -> DataFrame:
    df = (spark or get_spark()).read.format("binaryFile").load(_paths(paths)).withColumnRenamed("content", "bytes")
    return df.select("bytes", *(["path"] if include_paths else []))


def read_images(paths: str | list[str], include_paths: bool = False, spark: SparkSession | None = None) -> DataFrame:
    """Images with origin, width, height, channels, mode and decoded data (the reader of Spark itself)."""
    df = (spark or get_spark()).read.format("image").option("dropInvalid", True).load(_paths(paths)).select("image.*")
    return df if include_paths else df.drop("origin")


def read_records(paths: str | list[str], form: str = "json", schema: str | None = None, max_records: int | None = None, missing: str = "error", spark: SparkSession | None = None) -> DataFrame:
    """Located lines: value, path, row (from 1), error and raw.  Bad lines are kept with their error.

    ``form`` is json (value by ``schema``, or a map of strings) or text.  Lines of a file are
    numbered while the file is read by one task, gzip included.
    """
    spark = ship(spark or get_spark())
    if form not in ("json", "text"):
        raise InvalidRequest("form must be json or text")
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", missing == "ignore").load(_paths(paths)).select("path", "content")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                parts = data.split(b"\n")
                parts = parts[:-1] if parts and parts[-1] == b"" else parts
                for a in range(0, len(parts), 4096):
                    some = parts[a : a + 4096]
                    text, bad = [], []
                    for x in some:
                        try:
                            text.append(x.rstrip(b"\r").decode("utf-8"))
                            bad.append(None)
                        except UnicodeDecodeError as e:
                            text.append(None)
                            bad.append(f"not UTF-8: {e.reason}")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(some)), pa.array(range(a + 1, a + 1 + len(some)), pa.int64()), pa.array(text, pa.string()), pa.array(bad, pa.string()), pa.array(some, pa.binary())],
                        names=["path", "row", "text", "error", "raw"],
                    )

    df = files.mapInArrow(lines, "path string, row long, text string, error string, raw binary")
    if form == "json":
        kind = schema or "map<string,string>"
        parsed = F.from_json("text", kind, {"mode": "PERMISSIVE"})
        valid = F.try_parse_json("text").isNotNull() & F.ltrim("text").startswith("{")
        df = df.withColumn("value", F.when(valid, parsed)).withColumn("error", F.when(F.col("error").isNotNull(), F.col("error")).when(~F.coalesce(valid, F.lit(False)), "invalid JSON"))
    else:
        df = df.withColumn("value", F.col("text"))
    out = df.select("value", "path", "row", "error", "raw")
    return out.limit(max_records) if max_records is not None else out


def read_sql(sql: str, connect: Callable[[], Any], schema: str, params: tuple = (), spark: SparkSession | None = None) -> DataFrame:
    """Rows of a DB-API cursor, fetched in one task; ``connect`` is called there."""
    names = _names(spark or get_spark(), schema)

    def rows() -> Iterator[dict]:
        con = connect()
        try:
            cur = con.cursor()
            cur.execute(sql, params)
            while True:
                got = cur.fetchmany(1024)
                if not got:
                    return
                for r in got:
                    yield dict(zip(names, r))
        finally:
            con.close()

    return from_iter(rows, schema, spark)


@dataclass
class ReadTask(InputPartition):
    """One independent piece of an own source: a function that gives blocks (lists of dicts or Arrow tables)."""

    read: Callable[[], Iterable]

    def __init__(self, read: Callable[[], Iterable]):
        super().__init__(None)
        self.read = read


class Source:
    """The contract of an own source: a schema, and tasks for a wished parallelism."""

    schema: str = ""

    def get_read_tasks(self, parallelism: int) -> list[ReadTask]:
        raise NotImplementedError


def read_datasource(source: Source, parallelism: int | None = None, spark: SparkSession | None = None) -> DataFrame:
    """An own source through Spark's Python data source interface: one partition a task."""
    spark = ship(spark or get_spark())
    n = parallelism or spark.sparkContext.defaultParallelism
    kind = spark.createDataFrame([], source.schema).schema

    known = f"weftline_{uuid.uuid4().hex}"

    class _Reader(DataSourceReader):
        def partitions(self):
            return source.get_read_tasks(n)

        def read(self, partition):
            for block in partition.read():
                if isinstance(block, (pa.Table, pa.RecordBatch)):
                    block = block.to_pylist()
                for row in block:
                    yield tuple(row.get(f) for f in kind.names)

    class _Own(DataSource):
        @classmethod
        def name(cls):
            return known

        def schema(self):
            return kind

        def reader(self, schema):
            return _Reader()

    spark.dataSource.register(_Own)
    return spark.read.format(_Own.name()).load()


def read_table(uri: str, version: int | None = None, columns: list[str] | None = None, where: str | Column | None = None, projection: dict[str, str] | None = None, limit: int | None = None, spark: SparkSession | None = None) -> DataFrame:
    """A version of a versioned table with pushed down filter and projection."""
    return VersionedTable(spark or get_spark(), uri).read(version, columns, where, projection, limit)


def inspect_table(uri: str, version: int | None = None, spark: SparkSession | None = None) -> dict:
    return VersionedTable(spark or get_spark(), uri).inspect(version)


def vector_search(uri: str, vector: list[float], column: str, k: int, metric: str = "l2", version: int | None = None, columns: list[str] | None = None, where: str | Column | None = None, spark: SparkSession | None = None) -> DataFrame:
    """The ``k`` nearest rows of a versioned table, with ``_distance``; the filter comes before the search."""
    found = nearest(read_table(uri, version, where=where, spark=spark), vector, column, k, metric)
    return found.select(*columns, "_distance") if columns else found


def read_receipts(path: str, sha256: str, table: str = "receipts", schema: str = "document_id string, receipt string", spark: SparkSession | None = None) -> DataFrame:
    """Rows of a table in an SQLite backup whose content must have the given hash."""
    import hashlib

    h = hashlib.sha256()
    with open(path, "rb") as f:
        for part in iter(lambda: f.read(1 << 20), b""):
            h.update(part)
    if h.hexdigest() != sha256.lower():
        raise InvalidRequest(f"{path} has another hash")
    names = ", ".join(f'"{n}"' for n in _names(spark or get_spark(), schema))
    return read_sql(f'SELECT {names} FROM "{table}"', lambda: sqlite3.connect(f"file:{path}?mode=ro", uri=True), schema, spark=spark)


def unsupported(name: str, needs: str) -> Callable:
    """A source that needs a client or library which is not there."""

    def fail(*_: Any, **__: Any) -> None:
        raise UnsupportedSource(f"{name} needs {needs}")

    return fail


def struct(schema: str, spark: SparkSession | None = None) -> T.StructType:
    return (spark or get_spark()).createDataFrame([], schema).schema
