"""``Dataset``: an immutable, lazy wrapper of a DataFrame with the engine's operators as methods.

Every action runs the whole plan; :meth:`Dataset.materialize` pins a result.
``Dataset.df`` is the DataFrame, for everything Spark itself offers.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.errors import InvalidRequest, UnsupportedSource
from weftline.functions import embeddings, html, prompts, text
from weftline.operators import aggregates as agg
from weftline.operators import groups, joins, rows, stateful, vectors
from weftline.operators.keys import check_columns, json_order
from weftline.session import get_spark, materialize
from weftline.snapshot.table import Receipt, VersionedTable
from weftline.sources import readers, sinks
from weftline.streaming import streams


class Dataset:
    def __init__(self, df: DataFrame):
        self.df = df

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def _of(self, df: DataFrame) -> Dataset:
        return Dataset(df)

    # -- columns and rows

    def select_columns(self, cols: list[str] | str) -> Dataset:
        """These columns in this order; a missing one is a KeyError."""
        return self._of(self.df.select(*check_columns(self.df, cols)))

    def drop_columns(self, cols: list[str] | str) -> Dataset:
        return self._of(self.df.drop(*check_columns(self.df, cols)))

    def rename_columns(self, names: dict[str, str] | list[str]) -> Dataset:
        """By mapping (unknown names are ignored) or all names in order; the result must have distinct names."""
        if isinstance(names, dict):
            new = [names.get(c, c) for c in self.df.columns]
        else:
            new = list(names)
            if len(new) != len(self.df.columns):
                raise InvalidRequest(f"{len(new)} names for {len(self.df.columns)} columns")
        if len(set(new)) != len(new):
            raise InvalidRequest("two columns of one name")
        return self._of(self.df.toDF(*new))

    def add_column(self, name: str, value: Any, returns: Any = "double") -> Dataset:
        return self._of(rows.add_column(self.df, name, value, returns))

    def filter(self, fn: Any) -> Dataset:
        return self._of(rows.filter_rows(self.df, fn))

    def map(self, fn: Any, schema: Any = None, inputs: list[str] | None = None, output: str | None = None, outputs: list[str] | None = None, returns: Any = "string", args: tuple = (), kwargs: dict | None = None, catch: tuple = (), missed: Any = None) -> Dataset:
        """A whole row function, or with ``inputs`` one bound to columns."""
        if inputs is not None:
            return self._of(rows.map_bound(self.df, fn, inputs, output, outputs, returns, args, kwargs))
        return self._of(rows.map_rows(self.df, fn, schema, args, kwargs, catch, missed))

    def flat_map(self, fn: Any, schema: Any = None, args: tuple = (), kwargs: dict | None = None) -> Dataset:
        return self._of(rows.flat_map_rows(self.df, fn, schema, args, kwargs))

    def map_batches(self, fn: Any, schema: Any = None, batch_size: int | None = rows.BATCH, batch_format: str = "default", args: tuple = (), kwargs: dict | None = None, whole: bool = False) -> Dataset:
        return self._of(rows.map_batches(self.df, fn, schema, batch_size, batch_format, args, kwargs, whole))

    def map_async(self, fn: Any, schema: Any, concurrency: int = 16, catch: tuple = (), timeout: float | None = None) -> Dataset:
        return self._of(rows.map_async(self.df, fn, schema, concurrency, catch, timeout=timeout))

    def batch_map(self, fn: Any, schema: Any, max_batch: int = 32, batch_format: str = "default", failed: str | None = None) -> Dataset:
        return self._of(rows.batch_map(self.df, fn, schema, max_batch, batch_format, failed))

    def map_cached(self, fn: Any, inputs: list[str], output: str, returns: str, cache: str, version: str, when: Column | None = None) -> Dataset:
        return self._of(stateful.map_cached(self.df, fn, inputs, output, returns, VersionedTable(self.spark, cache), version, when))

    def random_sample(self, fraction: float, seed: int | None = None) -> Dataset:
        if not 0 <= fraction <= 1:
            raise InvalidRequest("a fraction lies between 0 and 1")
        return self._of(self.df.sample(False, float(fraction), seed))

    # -- several datasets

    def join(self, other: Dataset, on: Any, right_on: Any = None, how: str = "inner", suffix: str = "_right", strict: bool = False, presence: str | None = None) -> Dataset:
        return self._of(joins.join(self.df, other.df, on, right_on, how, suffix, strict, presence))

    def exclude_keys(self, other: Dataset, on: Any) -> Dataset:
        return self._of(joins.exclude_keys(self.df, other.df, on))

    def union(self, *others: Dataset) -> Dataset:
        return self._of(joins.union(self.df, *[o.df for o in others]))

    def prepend(self, other: Dataset, max_rows: int) -> Dataset:
        return self._of(joins.prepend(self.df, other.df, max_rows, "__rank").drop("__rank"))

    def lookup(self, source: Dataset, key: str, output: str) -> Dataset:
        return self._of(stateful.lookup(self.df, source.df, key, output))

    def lookup_table(self, uri: str, on: dict[str, str], columns: list[str], output: str, max_matches: int, version: int | None = None) -> Dataset:
        return self._of(stateful.lookup_list(self.df, VersionedTable(self.spark, uri).read(version), on, columns, output, max_matches))

    def search_vectors(self, query_id: str, query: str, uri: str, vector_id: str, vector_column: str, columns: list[str], top_k: int, output: str = "matches", metric: str = "l2", where: Any = None, same: tuple[str, str] | None = None, version: int | None = None) -> Dataset:
        """The nearest rows of a versioned table for every row, as a list."""
        table = VersionedTable(self.spark, uri).read(version)
        found = vectors.search(self.df, table, query_id, query, vector_id, vector_column, top_k, metric, where, same)
        return self._of(vectors.attach(self.df, found, query_id, table, vector_id, columns, output))

    # -- keys

    def aggregate(self, *aggs: agg.Aggregate | agg.AggregateFn) -> dict | None:
        return agg.aggregate(self.df, *aggs)

    def _each(self, kind: Any, on: Any, ignore_nulls: bool, **more: Any) -> Any:
        numeric = [f.name for f in self.df.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]
        names = [on] if isinstance(on, str) else list(on or numeric)
        found = agg.aggregate(self.df, *[kind(on=n, ignore_nulls=ignore_nulls, alias=n, **more) for n in names])
        return None if found is None else found[on] if isinstance(on, str) else found

    def sum(self, on: Any = None, ignore_nulls: bool = True) -> Any:
        return self._each(agg.Sum, on, ignore_nulls)

    def min(self, on: Any = None, ignore_nulls: bool = True) -> Any:
        return self._each(agg.Min, on, ignore_nulls)

    def max(self, on: Any = None, ignore_nulls: bool = True) -> Any:
        return self._each(agg.Max, on, ignore_nulls)

    def mean(self, on: Any = None, ignore_nulls: bool = True) -> Any:
        return self._each(agg.Mean, on, ignore_nulls)

    def std(self, on: Any = None, ddof: int = 1, ignore_nulls: bool = True) -> Any:
        return self._each(agg.Std, on, ignore_nulls, ddof=ddof)

    def count(self) -> int:
        return self.df.count()

    def reduce_by_key(self, on: Any, reducer: Any, schema: str | None = None, initial: Any = None, order: list[str] | None = None, combine: Any = None, ordered: bool = False) -> Dataset:
        """A dict of aggregate columns, or a Python fold with its schema; ``ordered`` sorts the result by the JSON text of the key."""
        keys = [on] if isinstance(on, str) else list(on)
        if isinstance(reducer, dict):
            out = groups.reduce_columns(self.df, keys, reducer)
        else:
            out = groups.reduce_by_key(self.df, keys, reducer, schema, initial, order, combine)
        return self._of(out.orderBy(json_order(out, keys)) if ordered else out)

    def group_batches(self, on: Any, max_rows: int = 32, order: list[str] | None = None, output: str = "items", flush_seconds: float | None = None) -> Dataset:
        if self.df.isStreaming:
            return self._of(streams.stream_group_batches(self.df, [on] if isinstance(on, str) else on, max_rows, flush_seconds or 0.0))
        return self._of(groups.group_batches(self.df, on, max_rows, order, output))

    def deduplicate(self, on: Any, arrival: str | None = None, keep_duplicates: bool = False, path: str | None = None, row_key: str | None = None) -> Dataset:
        keys = [on] if isinstance(on, str) else list(on)
        if self.df.isStreaming:
            return self._of(streams.stream_deduplicate(self.df, keys))
        return self._of(stateful.deduplicate(self.df, keys, arrival, keep_duplicates, VersionedTable(self.spark, path) if path else None, row_key))

    def admit_rows(self, unique_on: list[str] | None, quotas: dict[str, int], order: list[str], within: list[str] | None = None) -> Dataset:
        if not unique_on and len(quotas) == 1:
            column, limit = next(iter(quotas.items()))
            out = stateful.admit_quota(self.df, [column], limit, order)
            return self._of(out.withColumn("reason", F.when(F.col("status") == "limited", F.lit(column))))
        return self._of(stateful.admit_rows(self.df, unique_on, quotas, order, within))

    # -- order

    def sort(self, key: Any, descending: bool | list[bool] = False, boundaries: int | None = None) -> Dataset:
        """A global sort; ``boundaries`` sets the number of ranges."""
        keys = check_columns(self.df, key)
        down = [descending] * len(keys) if isinstance(descending, bool) else list(descending)
        if len(down) != len(keys):
            raise InvalidRequest("one direction for each key")
        order = [F.col(k).desc() if d else F.col(k).asc() for k, d in zip(keys, down)]
        if boundaries:
            return self._of(self.df.repartitionByRange(boundaries, *order).sortWithinPartitions(*order))
        return self._of(self.df.orderBy(*order))

    def limit(self, n: int) -> Dataset:
        return self._of(self.df.limit(n))

    def repartition(self, num_blocks: int | None = None, rows_per_block: int | None = None, keys: list[str] | None = None, shuffle: bool = True, sort: bool = False) -> Dataset:
        if (num_blocks is None) == (rows_per_block is None):
            raise InvalidRequest("num_blocks or rows_per_block")
        n = num_blocks or max(1, -(-self.df.count() // rows_per_block))
        out = self.df.repartition(n, *[F.col(k) for k in keys or []]) if shuffle or keys else self.df.coalesce(n)
        return self._of(out.sortWithinPartitions(*(keys or self.df.columns)) if sort else out)

    def random_shuffle(self, seed: int | None = None) -> Dataset:
        return self._of(self.df.orderBy(F.rand(seed)))

    def randomize_block_order(self, seed: int = 0) -> Dataset:
        """Partitions in another order; rows of one stay together."""
        n = self.df.rdd.getNumPartitions()
        return self._of(self.df.withColumn("__p", F.pmod(F.xxhash64(F.spark_partition_id(), F.lit(seed)), F.lit(1 << 30))).repartitionByRange(max(n, 1), "__p").drop("__p"))

    # -- results

    def take(self, n: int = 20) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.df.limit(n).collect()]

    def take_all(self, limit: int | None = None) -> list[dict]:
        """All rows; an error if there are more than ``limit``."""
        got = (self.df.limit(limit + 1) if limit is not None else self.df).collect()
        if limit is not None and len(got) > limit:
            raise InvalidRequest(f"more than {limit} rows")
        return [r.asDict(recursive=True) for r in got]

    def take_batch(self, n: int = 20, batch_format: str = "default") -> Any:
        return rows.as_format(self.df.limit(n).toArrow(), batch_format)

    def iter_rows(self) -> Iterator[dict]:
        for r in self.df.toLocalIterator(prefetchPartitions=True):
            yield r.asDict(recursive=True)

    def iter_batches(self, batch_size: int = 256, batch_format: str = "pyarrow", drop_last: bool = False) -> Iterator[Any]:
        """Batches, a partition at a time on the driver."""
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(self.df.schema)

        def parts() -> Iterator[pa.RecordBatch]:
            held: list[dict] = []
            for r in self.iter_rows():
                held.append(r)
                if len(held) == batch_size:
                    yield pa.RecordBatch.from_pylist(held, schema=target)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=target)

        for t in rows.rechunk(parts(), batch_size, drop_last):
            yield rows.as_format(t, batch_format)

    def schema(self) -> Any:
        return self.df.schema

    def columns(self) -> list[str]:
        return self.df.columns

    def size_bytes(self) -> int:
        return int(str(self.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    def stats(self, mode: str = "formatted") -> str:
        return self.df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    def execution_metadata(self) -> dict:
        return {"engine": "spark", "version": self.spark.version, "partitions": self.spark.conf.get("spark.sql.shuffle.partitions"), "streaming": self.df.isStreaming}

    def materialize(self) -> MaterializedDataset:
        return MaterializedDataset(self.df)

    # -- writing

    def checkpoint(self, path: str, version: str) -> Dataset:
        return self._of(sinks.checkpoint(self.df, path, version))

    def checkpoint_table(self, uri: str, fingerprint: str | None = None) -> Dataset:
        return self._of(sinks.checkpoint_table(self.df, VersionedTable(self.spark, uri), fingerprint or sinks.plan_fingerprint(self.df)))

    def checkpoint_async(self, path: str, version: str) -> threading.Thread:
        """The checkpoint in a thread of its own; join it and read with :meth:`checkpoint`."""
        t = threading.Thread(target=sinks.checkpoint, args=(self.df, path, version))
        t.start()
        return t

    def write_parquet(self, path: str, **options: Any) -> None:
        sinks.write_parquet(self.df, path, **options)

    def write_json(self, path: str, **options: Any) -> None:
        sinks.write_json(self.df, path, **options)

    def write_csv(self, path: str, **options: Any) -> None:
        sinks.write_csv(self.df, path, **options)

    def write_datasink(self, sink: sinks.Sink) -> Any:
        return sinks.write_datasink(self.df, sink)

    def write_table(self, uri: str, mode: str = "create", expected_version: int | None = None, on: Any = None, update_columns: list[str] | None = None, when_not_matched: str = "error") -> Receipt:
        return VersionedTable(self.spark, uri).commit(self.df, mode, expected_version, on, update_columns, when_not_matched)

    def run_stream(self, each: Callable[[DataFrame, int], None], checkpoint: str, **options: Any) -> streams.StreamStats:
        return streams.run_stream(self.df, each, checkpoint, **options)

    def save_table(self, uri: str, checkpoint: str, stage: str = "save", mode: str = "append", on: list[str] | None = None, **options: Any) -> streams.StreamStats:
        """A stream into a versioned table, one version a batch, each once."""
        return streams.run_stream(self.df, streams.save_batches(VersionedTable(self.spark, uri), stage, mode, on), checkpoint, **options)

    def enqueue(self, uri: str, task_id: str, value: str) -> int:
        return streams.MessageQueue(self.spark, uri).enqueue(self.df, task_id, value)

    def ack_queue(self, uri: str, task_id: str, result: str) -> None:
        streams.MessageQueue(self.spark, uri).ack(self.df, task_id, result)

    # -- text, pages and models

    def parse_pages(self, body: str, content_type: str | None = None, output: str = "blocks") -> Dataset:
        return self._of(html.page_blocks(self.df, body, content_type, output))

    def read_documents(self, questions: Dataset, budget: int, heading_weight: int = 1, min_matches: int = 1) -> Dataset:
        """Blocks (document_id, position, kind, headings, text) chosen for each question within a budget of characters."""
        ranked = text.rank_blocks(self.df, questions.df, ["document_id", "position"], heading_weight, min_matches)
        cost = self.df.select("document_id", "position", F.length("text").alias("cost"))
        return self._of(text.admit_blocks(ranked.join(cost, ["document_id", "position"]), "cost", budget))

    def map_prompt(self, template: str, client: Callable[[str], str], output: str = "answer", schema: dict | None = None, journal: str | None = None, version: str = "1") -> Dataset:
        return self._of(prompts.map_prompt(self.df, template, client, output, schema, journal=VersionedTable(self.spark, journal) if journal else None, version=version))

    def map_embeddings(self, column: str, encoder: Any, dim: int, output: str = "embedding") -> Dataset:
        return self._of(embeddings.map_embeddings(self.df, column, encoder, dim, output))

    def map_client(self, client: Any, schema: Any, concurrency: int = 16) -> Dataset:
        """Web search, fetching, agents and the like: rows through a client that the caller brings."""
        if client is None:
            raise UnsupportedSource("network nodes need a client of your own")
        return self._of(rows.map_async(self.df, client, schema, concurrency))


class MaterializedDataset(Dataset):
    """A pinned result; freed by :meth:`release` or at the end of a ``with`` block.

    ``durable`` writes it to the shared folder, where it outlives lost executors;
    otherwise it is cached in memory and on disk.
    """

    def __init__(self, df: DataFrame, durable: bool = False):
        super().__init__(materialize(df, "pinned") if durable else df.persist(StorageLevel.MEMORY_AND_DISK))
        self.rows = self.df.count()

    def count(self) -> int:
        return self.rows

    def num_blocks(self) -> int:
        return self.df.rdd.getNumPartitions()

    def release(self) -> None:
        self.df.unpersist()

    def __enter__(self) -> MaterializedDataset:
        return self

    def __exit__(self, *_: Any) -> None:
        self.release()


def from_items(items: list, schema: Any = None, spark: SparkSession | None = None) -> Dataset:
    return Dataset(readers.from_items(items, schema, spark))


def from_iter(factory: Callable[[], Iterable[dict]], schema: str, spark: SparkSession | None = None) -> Dataset:
    return Dataset(readers.from_iter(factory, schema, spark))


def range(n: int, spark: SparkSession | None = None) -> Dataset:  # noqa: A001
    return Dataset(readers.range_(n, spark))


def from_arrow(tables: Any, spark: SparkSession | None = None) -> Dataset:
    return Dataset(readers.from_arrow(tables, spark))


def from_numpy(arrays: Any, spark: SparkSession | None = None) -> Dataset:
    return Dataset(readers.from_numpy(arrays, spark))


def from_pandas(frames: Any, spark: SparkSession | None = None) -> Dataset:
    return Dataset(readers.from_pandas(frames, spark))


def read(kind: str, *args: Any, **options: Any) -> Dataset:
    """``read("parquet", path)``: any reader of :mod:`weftline.sources.readers` by its name."""
    fn = getattr(readers, f"read_{kind}", None)
    if fn is None:
        raise UnsupportedSource(f"no reader for {kind!r}")
    return Dataset(fn(*args, **options))


def read_parquet(paths: Any, **options: Any) -> Dataset:
    return Dataset(readers.read_parquet(paths, **options))


def read_json(paths: Any, **options: Any) -> Dataset:
    return Dataset(readers.read_json(paths, **options))


def read_csv(paths: Any, **options: Any) -> Dataset:
    return Dataset(readers.read_csv(paths, **options))


def read_text(paths: Any, **options: Any) -> Dataset:
    return Dataset(readers.read_text(paths, **options))


def read_records(paths: Any, **options: Any) -> Dataset:
    return Dataset(readers.read_records(paths, **options))


def read_table(uri: str, **options: Any) -> Dataset:
    return Dataset(readers.read_table(uri, **options))


def read_queue(uri: str, through: int | None = None, results: bool = False, spark: SparkSession | None = None) -> Dataset:
    return Dataset(streams.MessageQueue(spark or get_spark(), uri).read(through, results))


def sql(query: str, spark: SparkSession | None = None, **sources: Dataset) -> Dataset:
    """A SELECT over named datasets."""
    return Dataset((spark or get_spark()).sql(query, **{k: v.df for k, v in sources.items()}))
