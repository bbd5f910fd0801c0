"""Streams: run to the end of what there is, stateful steps, and idempotent sinks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from weftline.errors import StallError
from weftline.operators.keys import check_columns
from weftline.session import materialize, ship
from weftline.snapshot.table import VersionedTable


@dataclass
class StreamStats:
    """Rows in, batches, seconds, and the last progress of each batch."""

    rows_in: int = 0
    batches: int = 0
    seconds: float = 0.0
    progress: list[dict] = field(default_factory=list)


def read_stream(spark: SparkSession, path: str, schema: Any = None, form: str = "parquet", per_batch: int | None = None, pattern: str | None = None) -> DataFrame:
    """New files of a folder as a stream."""
    r = spark.readStream.format(form)
    if schema is None:
        schema = spark.read.format(form).load(f"{path}/{pattern}" if pattern else path).schema
    r = r.schema(schema)
    if per_batch:
        r = r.option("maxFilesPerTrigger", per_batch)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.load(path)


def run_stream(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", on_progress: Callable[[dict], None] | None = None, stall_timeout: float | None = None, stop: Callable[[], bool] | None = None, follow: bool = False, interval: str = "1 second") -> StreamStats:
    """Drive a stream through ``each(batch, number)`` until its input is used up (or ``stop()`` says so with ``follow``).

    A batch number is retried after a failure, so ``each`` must be idempotent,
    as :func:`save_batches` is.
    """
    ship(df.sparkSession)
    w = df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
    began = time.time()
    q: StreamingQuery = (w.trigger(processingTime=interval) if follow else w.trigger(availableNow=True)).start()
    stats, last, seen = StreamStats(), began, set()

    def look() -> None:
        nonlocal last
        for p in q.recentProgress:
            p = dict(p) if isinstance(p, dict) else p.jsonValue if hasattr(p, "jsonValue") else {"batchId": p.batchId, "numInputRows": p.numInputRows}
            if p["batchId"] not in seen:
                seen.add(p["batchId"])
                stats.batches += 1
                stats.rows_in += int(p.get("numInputRows") or 0)
                stats.progress.append(p)
                last = time.time()
                if on_progress:
                    on_progress(p)

    try:
        while q.isActive:
            q.awaitTermination(0.2)
            look()
            if stop and stop():
                q.stop()
            if stall_timeout and time.time() - last > stall_timeout and q.isActive:
                q.stop()
                raise StallError(f"no batch within {stall_timeout} s")
        look()
        if q.exception():
            raise q.exception()
    finally:
        if q.isActive:
            q.stop()
    stats.seconds = time.time() - began
    return stats


def save_batches(table: VersionedTable, stage: str, mode: str = "append", on: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """A sink for :func:`run_stream`: one version a batch, and a batch that is there already is not written again."""

    def each(batch: DataFrame, number: int) -> None:
        mark = f"{stage}:{number}"
        if table.find_key("batch", mark) is not None or table.find(mark) is not None:
            return
        if mode == "merge" and table.head():
            table.merge(batch, on, when_not_matched="insert", operation_id=mark)
        else:
            table.commit(batch, "append", expected_version=table.head(), keys={"batch": mark}, operation_id=mark, skip_empty=True)

    return each


def save_to_all(*saves: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Several sinks for one stream: a batch is over when all have it.

    Each sink must be idempotent, as those of :func:`save_batches` are: after a
    stop between two sinks the batch comes again, and sinks that have it skip it.
    The batch is written once and read by every sink, so all see the same rows.
    """

    def each(batch: DataFrame, number: int) -> None:
        held = materialize(batch, "batch")
        for save in saves:
            save(held, number)

    return each


def stream_deduplicate(df: DataFrame, on: list[str], event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """First arrivals of a stream; with a watermark the state of old keys is dropped."""
    check_columns(df, on)
    if event_time and delay:
        return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(on)
    return df.dropDuplicates(on)


class _Batcher(StatefulProcessor):
    """Rows of a key until there are enough of them or the time is up."""

    def __init__(self, names: list[str], max_rows: int, flush_ms: int, key_names: list[str], schema: str):
        self.names, self.max_rows, self.flush_ms, self.key_names, self.row_schema = names, max_rows, flush_ms, key_names, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.row_schema)

    def _out(self, key: tuple, rows: list) -> pd.DataFrame:
        items = [dict(zip(self.names, r)) for r in rows]
        return pd.DataFrame({**{k: [v] for k, v in zip(self.key_names, key)}, "items": [items]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.rows.get()]
        was = bool(held)
        for frame in rows:
            for r in frame[self.names].itertuples(index=False, name=None):
                held.append(tuple(None if x is pd.NaT or (isinstance(x, float) and x != x) else x for x in r))
                if len(held) >= self.max_rows:
                    yield self._out(key, held)
                    held, was = [], False
        if held:
            self.rows.put(held)
            if not was and self.flush_ms:
                self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.flush_ms)
        else:
            self.rows.clear()

    def handleExpiredTimer(self, key: tuple, timers, expired) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.rows.get()]
        if held:
            self.rows.clear()
            yield self._out(key, held)

    def close(self) -> None: ...


def stream_group_batches(df: DataFrame, on: list[str], max_rows: int = 32, flush_seconds: float = 0.0) -> DataFrame:
    """Keyed micro-batches of a stream: keys and items, out when there are ``max_rows`` or the processing time is up.

    Without ``flush_seconds`` rows below a full batch wait in the state for the
    next run; with it, use a following stream (``follow``), since a timer needs
    time to pass.  Needs the RocksDB state store.
    """
    ship(df.sparkSession)
    keys = check_columns(df, on, "keys")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields) + f", items array<struct<{', '.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in df.schema.fields)}>>"
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Batcher(df.columns, max_rows, int(flush_seconds * 1000), keys, schema), outputStructType=out, outputMode="Append", timeMode="ProcessingTime" if flush_seconds else "None"
    )


class MessageQueue:
    """A durable queue as two versioned tables: messages with rising sequence numbers, and results.

    Messages are immutable; a task is open while it has no result.  Workers take
    tasks by :meth:`claim`: a claim holds until its lease ends, and a task that was
    claimed ``attempts`` times without a result is dead.
    """

    def __init__(self, spark: SparkSession, uri: str):
        self.spark = spark
        self.messages = VersionedTable(spark, f"{uri.rstrip('/')}/messages")
        self.results = VersionedTable(spark, f"{uri.rstrip('/')}/results")
        self.claims = VersionedTable(spark, f"{uri.rstrip('/')}/claims")

    def high_water(self) -> int:
        if not self.messages.head():
            return 0
        return int(self.messages.manifest().rows)

    def enqueue(self, df: DataFrame, task_id: str, value: str) -> int:
        """Append messages (task_id, value); task ids that are there already are not sent twice.  The new high-water mark."""
        from weftline.operators.ranking import ordered_rank

        rows = df.select(F.col(task_id).cast("string").alias("task_id"), F.col(value).cast("string").alias("value")).dropDuplicates(["task_id"])
        if self.messages.head():
            rows = rows.join(self.messages.read().select("task_id"), "task_id", "left_anti")
        base = self.high_water()
        numbered = ordered_rank(rows.withColumn("__all", F.lit(0)), ["__all"], ["task_id"], "sequence")
        fresh = numbered.select((F.col("sequence") + base).cast("long").alias("sequence"), "task_id", "value")
        if not fresh.isEmpty():
            self.messages.commit(fresh, "append", expected_version=self.messages.head())
        return self.high_water()

    def read(self, through: int | None = None, results: bool = False) -> DataFrame:
        """Messages up to a high-water mark in order, with their result if asked for."""
        if not self.messages.head():
            return self.spark.createDataFrame([], "sequence long, task_id string, value string" + (", result string" if results else ""))
        df = self.messages.read(where=F.col("sequence") <= through if through is not None else None)
        if results:
            done = self.results.read() if self.results.head() else self.spark.createDataFrame([], "task_id string, result string")
            df = df.join(done, "task_id", "left").select("sequence", "task_id", "value", "result")
        return df.orderBy("sequence")

    def open_tasks(self) -> DataFrame:
        """Messages without a result."""
        df = self.read()
        return df.join(self.results.read().select("task_id"), "task_id", "left_anti") if self.results.head() else df

    def ack(self, df: DataFrame, task_id: str, result: str) -> None:
        """Store results; a task that has one keeps it."""
        rows = df.select(F.col(task_id).cast("string").alias("task_id"), F.col(result).cast("string").alias("result")).dropDuplicates(["task_id"])
        if self.results.head():
            rows = rows.join(self.results.read().select("task_id"), "task_id", "left_anti")
        if not rows.isEmpty():
            self.results.commit(rows, "append", expected_version=self.results.head())

    def _claimed(self) -> DataFrame:
        """Each claimed task with its number of claims and the end of its last lease."""
        held = self.claims.read() if self.claims.head() else self.spark.createDataFrame([], "task_id string, worker string, until double")
        return held.groupBy("task_id").agg(F.count(F.lit(1)).alias("attempt"), F.max("until").alias("until"))

    def claim(self, worker: str, limit: int, lease_seconds: float, attempts: int = 3, now: float | None = None) -> DataFrame:
        """Up to ``limit`` open tasks in order that no live lease holds, now held by ``worker``: sequence, task_id, value, attempt.

        Of two workers that claim at once one gets ``WriteConflict`` and asks again.
        """
        now = time.time() if now is None else now
        head = self.claims.head()
        free = self.open_tasks().join(self._claimed(), "task_id", "left").where((F.coalesce("until", F.lit(0.0)) <= now) & (F.coalesce("attempt", F.lit(0)) < attempts))
        taken = materialize(free.orderBy("sequence").limit(limit).select("sequence", "task_id", "value", (F.coalesce("attempt", F.lit(0)) + 1).cast("int").alias("attempt")), "claimed")
        self.claims.commit(taken.select("task_id", F.lit(worker).alias("worker"), F.lit(float(now + lease_seconds)).alias("until")), "append", expected_version=head, skip_empty=head > 0)
        return taken.orderBy("sequence")

    def dead_tasks(self, attempts: int = 3, now: float | None = None) -> DataFrame:
        """Open tasks that were claimed ``attempts`` times and whose last lease is over."""
        over = self._claimed().where((F.col("attempt") >= attempts) & (F.col("until") <= (time.time() if now is None else now)))
        return self.open_tasks().join(over.select("task_id"), "task_id", "left_semi")
