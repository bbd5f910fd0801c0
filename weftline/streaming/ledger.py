"""A ledger of calls: a long map that goes on where it was stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weftline.errors import InvalidRequest
from weftline.operators.keys import check_columns
from weftline.session import ship
from weftline.snapshot.table import VersionedTable

#: A call that failed is asked again on a later run, until it has failed ``attempts`` times.
COMPLETED, RETRYABLE, FAILED = "completed", "retryable", "failed"


def states(ledger: VersionedTable, key: str, attempts: int = 3) -> DataFrame:
    """(key, state, attempts, error): what the ledger knows of each key."""
    seen = ledger.read().groupBy(key).agg(
        F.max(F.col("state") == COMPLETED).alias("__done"), F.count_if(F.col("state") != COMPLETED).alias("attempts"), F.max_by("error", F.col("attempt")).alias("error")
    )
    state = F.when(F.col("__done"), COMPLETED).when(F.col("attempts") >= attempts, FAILED).otherwise(RETRYABLE)
    return seen.select(key, state.alias("state"), "attempts", F.when(~F.col("__done"), F.col("error")).alias("error"))


def map_ledger(df: DataFrame, key: str, call: Callable[[dict], dict], schema: str, ledger: VersionedTable, parts: int = 8, attempts: int = 3, stop: Callable[[], bool] | None = None) -> DataFrame:
    """The key and the columns of ``schema`` for every row whose call has succeeded, on this run or an earlier one.

    Rows are worked on in ``parts`` parts by the hash of their key; each part is
    one version of the ledger, so a run that is stopped loses one part at most.
    Keys must be unique; null keys are left out.  A failed call is noted with its
    error, does not stop the others, and comes again on the next run until it has
    failed ``attempts`` times.
    """
    spark = ship(df.sparkSession)
    check_columns(df, [key])
    out = T.StructType([df.schema[key], *spark.createDataFrame([], schema).schema.fields])
    if len(set(out.names)) != len(out.names) or {"state", "error", "attempt"} & set(out.names):
        raise InvalidRequest("names of the result clash with the key or with state, error and attempt")
    kept = T.StructType([*out.fields, T.StructField("state", T.StringType()), T.StructField("error", T.StringType()), T.StructField("attempt", T.IntegerType())])
    arrow = to_arrow_schema(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                attempt = r.pop("__attempt")
                try:
                    rows.append({**call(r), key: r[key], "state": COMPLETED, "error": None, "attempt": attempt})
                except Exception as e:
                    rows.append({key: r[key], "state": RETRYABLE, "error": f"{type(e).__name__}: {e}", "attempt": attempt})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    todo = df.where(F.col(key).isNotNull())
    for part in range(parts):
        if stop and stop():
            break
        mine = todo.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part)
        if ledger.head():
            known = states(ledger, key, attempts).select(key, F.col("state").alias("__state"), F.col("attempts").alias("__failed"))
            mine = mine.join(known, key, "left").where(F.coalesce("__state", F.lit(RETRYABLE)) == RETRYABLE).withColumn("__attempt", (F.coalesce("__failed", F.lit(0)) + 1).cast("int")).drop("__state", "__failed")
        else:
            mine = mine.withColumn("__attempt", F.lit(1))
        ledger.commit(mine.mapInArrow(run, kept), "append", expected_version=ledger.head(), skip_empty=ledger.head() > 0)
    done = ledger.read(where=F.col("state") == COMPLETED).select(*out.names) if ledger.head() else spark.createDataFrame([], out)
    return done.join(todo.select(key), key, "left_semi")
