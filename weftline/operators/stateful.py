"""First arrivals, quotas and lookups, in the batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import InvalidRequest
from weftline.operators.keys import check_columns
from weftline.operators.ranking import ordered_rank
from weftline.session import ship
from weftline.snapshot.table import VersionedTable


def first_arrivals(df: DataFrame, on, arrival: str, when: Column | None = None, status: str = "status") -> DataFrame:
    """Each row with ``admitted``, ``duplicate`` or ``skipped`` (where ``when`` is false).

    The winner of a key has the least ``arrival``; the least arrival of each key
    is an aggregate, combined before the shuffle, so a hot key is no burden.
    Ties in ``arrival`` are broken by the content of the row.
    """
    keys = check_columns(df, on, "keys")
    take = F.coalesce(when, F.lit(False)) if when is not None else F.lit(True)
    marked = df.withColumn("__take", take).withColumn("__mark", F.struct(F.col(arrival), F.xxhash64(*df.columns)))
    least = marked.where("__take").groupBy(*keys).agg(F.min("__mark").alias("__least"))
    cond = F.lit(True)
    renamed = least.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__least")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = marked.join(renamed, cond, "left")
    value = F.when(~F.col("__take"), "skipped").when(F.col("__mark").eqNullSafe(F.col("__least")), "admitted").otherwise("duplicate")
    return joined.select(*df.columns, value.alias(status))


def deduplicate(df: DataFrame, on, arrival: str, keep_duplicates: bool = False, winners: VersionedTable | None = None, row_key: str | None = None) -> DataFrame:
    """The first row of each key.

    With a ``winners`` table the choice is durable: keys that it knows keep
    their winner (named by ``row_key``) whatever arrives later, and new ones are
    appended, so a replay in another order returns the same rows.
    """
    keys = check_columns(df, on, "keys")
    if winners is None:
        out = first_arrivals(df, keys, arrival)
    else:
        if row_key is None:
            raise InvalidRequest("durable winners need a row_key")
        known = winners.read() if winners.head() else df.select(*keys, F.col(row_key).alias("__winner")).limit(0)
        fresh = first_arrivals(df.join(known.select(*keys), keys, "left_anti"), keys, arrival).where(F.col("status") == "admitted").select(*keys, F.col(row_key).alias("__winner"))
        if not fresh.isEmpty():
            winners.commit(fresh, "append", expected_version=winners.head())
        final = winners.read() if winners.head() else known
        cond = F.lit(True)
        renamed = final.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__winner")
        for i, k in enumerate(keys):
            cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        value = F.when(F.col(row_key).eqNullSafe(F.col("__winner")), "admitted").otherwise("duplicate")
        out = df.join(renamed, cond, "left").select(*df.columns, value.alias("status"))
    return out if keep_duplicates else out.where(F.col("status") == "admitted").drop("status")


def admit_quota(df: DataFrame, group: list[str], limit: int, order: list, status: str = "status") -> DataFrame:
    """One quota: the first ``limit`` rows of each group in ``order`` are admitted, the others limited."""
    check_columns(df, group, "groups")
    if limit < 0:
        raise InvalidRequest("a limit must not be negative")
    ranked = ordered_rank(df, list(group), order, "__rank")
    return ranked.withColumn(status, F.when(F.col("__rank") <= limit, "admitted").otherwise("limited")).drop("__rank")


def admit_rows(df: DataFrame, unique_on: list[str] | None, quotas: dict[str, int], order: list[str], within: list[str] | None = None) -> DataFrame:
    """Duplicates and several quotas at once: each row with ``status`` and ``reason``.

    Rows are taken in ``order``.  A row whose ``unique_on`` was admitted before is
    a duplicate; else it is limited if any quota (column -> limit for each of
    its values) is used up, and then uses none; else it is admitted.  Each decision depends on all
    earlier ones, so rows that share a quota are seen by one task in sequence:
    ``within`` names columns that split the rows into independent parts (each
    quota and key must lie within one part), and every part is streamed in
    sorted order, holding only the counters.
    """
    ship(df.sparkSession)
    for c in [*(unique_on or []), *quotas, *order, *(within or [])]:
        check_columns(df, [c])
    schema = T.StructType([*df.schema.fields, T.StructField("status", T.StringType()), T.StructField("reason", T.StringType())])
    parts = list(within or [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: dict[tuple, int] = {}
        seen: set[tuple] = set()
        now: tuple | None = None
        for b in batches:
            cols = {n: b.column(b.schema.get_field_index(n)).to_pylist() for n in {*(unique_on or []), *quotas, *parts}}
            status, reason = [], []
            for i in range(b.num_rows):
                part = tuple(cols[p][i] for p in parts)
                if part != now:
                    used, seen, now = {}, set(), part
                key = tuple(cols[c][i] for c in unique_on) if unique_on else None
                full = next((q for q, limit in quotas.items() if used.get((q, cols[q][i]), 0) >= limit), None)
                if key is not None and key in seen:
                    status.append("duplicate")
                    reason.append(",".join(unique_on))
                elif full is not None:
                    status.append("limited")
                    reason.append(full)
                else:
                    if key is not None:
                        seen.add(key)
                    for q in quotas:
                        used[(q, cols[q][i])] = used.get((q, cols[q][i]), 0) + 1
                    status.append("admitted")
                    reason.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(status, pa.string()), pa.array(reason, pa.string())], names=[*b.schema.names, "status", "reason"])

    laid = df.repartition(*[F.col(p) for p in parts]) if parts else df.coalesce(1)
    return laid.sortWithinPartitions(*parts, *order).mapInArrow(run, schema)


def remaining(df: DataFrame, admitted: DataFrame, quota: str, limit: int, output: str = "remaining") -> DataFrame:
    """Each row with what is left of its quota."""
    used = admitted.groupBy(F.col(quota).alias("__q")).agg(F.count(F.lit(1)).alias("__used"))
    return df.join(used, F.col(quota).eqNullSafe(F.col("__q")), "left").withColumn(output, F.greatest(F.lit(0), F.lit(limit) - F.coalesce("__used", F.lit(0))).cast("long")).drop("__q", "__used")


def lookup(df: DataFrame, source: DataFrame, key: str, output: str, source_key: str = "key", value: str = "value") -> DataFrame:
    """Attach ``{hit, value}`` of a key; keys of the source must be unique.  Null keys miss."""
    right = source.select(F.col(source_key).alias("__k"), F.col(value).alias("__v"), F.lit(True).alias("__hit"))
    joined = df.join(right, F.col(key) == F.col("__k"), "left")
    return joined.withColumn(output, F.struct(F.coalesce("__hit", F.lit(False)).alias("hit"), F.col("__v").alias("value"))).drop("__k", "__v", "__hit")


def lookup_list(df: DataFrame, source: DataFrame, on: dict[str, str], columns: list[str], output: str, max_matches: int) -> DataFrame:
    """Attach the matching rows of ``source`` as a list; more than ``max_matches`` of them is an error.

    ``on`` maps a column here to one there.  Matches are counted before they are
    gathered, so a list never grows beyond the limit.
    """
    keys = list(on.values())
    check_columns(source, keys, "keys")
    n = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    few = source.join(n.where(F.col("__n") <= max_matches), keys)
    lists = few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("__list"))
    right = n.join(lists, keys, "left").select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__n", "__list")
    cond = F.lit(True)
    for i, a in enumerate(on):
        cond = cond & (F.col(a) == F.col(f"__k{i}"))
    joined = df.join(right, cond, "left")
    guarded = F.when(F.coalesce("__n", F.lit(0)) > max_matches, F.raise_error(F.lit(f"more than {max_matches} matches"))).otherwise(F.coalesce("__list", F.array()))
    return joined.withColumn(output, guarded).drop("__n", "__list", *[f"__k{i}" for i in range(len(keys))])


def map_cached(df: DataFrame, fn, inputs: list[str], output: str, returns: str, cache: VersionedTable, version: str, when: Column | None = None) -> DataFrame:
    """Call ``fn`` once for each distinct input; results are kept in a table under the hash of version and inputs.

    Rows where ``when`` is false get null.  A failed call fails the action and is not kept.
    """
    from weftline.operators.rows import map_bound

    check_columns(df, inputs, "inputs")
    key = F.sha2(F.concat(F.lit(version), F.lit("\x00"), F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"})), 256)
    keyed = df.withColumn("__key", F.when(when, key) if when is not None else key)
    asked = keyed.where("__key IS NOT NULL").groupBy("__key").agg(*[F.first(c).alias(c) for c in inputs])
    known = cache.read() if cache.head() else df.sparkSession.createDataFrame([], f"__key string, __value {returns}")
    missing = asked.join(known, "__key", "left_anti")
    if not missing.isEmpty():
        cache.commit(map_bound(missing, fn, inputs, "__value", returns=returns).select("__key", "__value"), "append", expected_version=cache.head())
        known = cache.read()
    return keyed.join(known, "__key", "left").withColumnRenamed("__value", output).drop("__key")
