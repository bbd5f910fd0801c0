"""Registered queries of the general operators, over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import dataset as W
from weftline.functions import text, urls
from weftline.functions.embeddings import HashEncoder, document_spans, map_embeddings
from weftline.functions.html import page_blocks
from weftline.functions.prompts import EchoClient, map_prompt, render
from weftline.operators import aggregates as A
from weftline.operators import groups, joins, ranking, rows, stateful, vectors
from weftline.operators.components import connected_components
from weftline.operators.keys import json_order
from weftline.session import scratch_root, table
from weftline.snapshot.digests import row_digest
from weftline.snapshot.table import VersionedTable
from weftline.sources import readers, sinks
from weftline.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession) -> VersionedTable:
    return VersionedTable(spark, f"{scratch_root(spark)}/weftline/t-{uuid.uuid4().hex}")


def _money(c) -> F.Column:
    return F.sum(c.cast("decimal(18,2)")).cast("double")


# -- scans, projections, filters


@query
def scan_project(spark, d):
    return readers.read_parquet(f"{d}/orders.parquet", columns=["o_orderkey", "o_custkey", "o_totalprice"], spark=spark)


@query
def filter_pred(spark, d):
    return rows.filter_rows(table(spark, d, "lineitem"), "l_shipdate >= TIMESTAMP_NTZ '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query
def filter_python(spark, d):
    return rows.filter_rows(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), lambda r: r["p_size"] % 7 == 3 and len(r["p_name"]) > 10)


@query
def rename_drop_add(spark, d):
    c = W.Dataset(table(spark, d, "customer")).drop_columns("c_name").rename_columns({"c_custkey": "id", "c_acctbal": "balance"})
    return c.add_column("owes", F.col("balance") < 0).df


@query
def add_column_batch(spark, d):
    return rows.add_column(table(spark, d, "part").select("p_partkey", "p_retailprice"), "cents", lambda f: (f["p_retailprice"] * 100).round(), "double")


@query
def limit_rows(spark, d):
    """The first rows of a sorted table, and how many a limit beyond the table lets through."""
    o = W.Dataset(table(spark, d, "orders").select("o_orderkey", "o_totalprice"))
    return o.sort("o_orderkey").limit(1000).df.withColumn("all", F.lit(o.limit(1 << 30).count()))


@query
def sort_limit(spark, d):
    return W.Dataset(table(spark, d, "orders")).sort(["o_totalprice", "o_orderkey"], descending=[True, False]).limit(100).select_columns(["o_orderkey", "o_totalprice"]).df


@query
def json_key_order(spark, d):
    n = table(spark, d, "nation")
    return n.orderBy(json_order(n, ["n_nationkey"])).limit(12).select("n_nationkey", "n_name")


# -- joins and unions


@query
def join_inner(spark, d):
    return joins.join(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "o_custkey", "c_custkey")


@query
def join_left(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return joins.join(table(spark, d, "customer").select("c_custkey", "c_name"), big, "c_custkey", how="left", presence="matched").fillna({"o_orderkey": 0})


@query
def join_semi(spark, d):
    return joins.join(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").where("o_orderstatus = 'F'"), "c_custkey", "o_custkey", "semi")


@query
def join_anti(spark, d):
    return joins.join(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").where("o_totalprice > 100000"), "c_custkey", "o_custkey", "anti")


@query
def join_composite(spark, d):
    a = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    b = a.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")
    return joins.join(a, b, ["l_partkey", "l_suppkey"])


@query
def join_right_on_suffix(spark, d):
    a = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"))
    b = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    return joins.join(a, b, "nation", "n_nationkey")


@query
def join_key_families(spark, d):
    """A whole number and a string never match, whatever their digits."""
    a = table(spark, d, "nation").select("n_nationkey", "n_name")
    b = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("n_nationkey"), "r_name")
    return joins.join(a, b, "n_nationkey", how="left").select("n_nationkey", "n_name", "r_name")


@query
def exclude_keys(spark, d):
    return joins.exclude_keys(table(spark, d, "part").select("p_partkey", "p_name"), table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query
def union_all(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("kind"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return joins.union(a, b)


@query
def prepend_rows(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return joins.prepend(n, r, 100, "ahead")


@query
def join_chain_reduce(spark, d):
    """Flagship: orders, customers and nations joined, reduced by nation and status."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_totalprice")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    j = joins.join(joins.join(o, c, "o_custkey", "c_custkey"), n, "c_nationkey", "n_nationkey")
    return groups.reduce_columns(j, ["n_name", "o_orderstatus"], {"n_orders": F.count(F.lit(1)), "total": _money(F.col("o_totalprice"))})


@query
def bench_join_reduce(spark, d):
    """Lineitems joined to parts and reduced by brand: join and keyed reduction over the largest table."""
    line = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice")
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    return groups.reduce_columns(joins.join(line, part, "l_partkey", "p_partkey"), "p_brand", {"n": F.count(F.lit(1)), "quantity": F.sum("l_quantity"), "revenue": _money(F.col("l_extendedprice"))})


# -- aggregates


@query
def agg_global(spark, d):
    df = table(spark, d, "lineitem").select("l_quantity", "l_discount")
    aggs = [A.Count(alias="n"), A.Sum("l_quantity", alias="total"), A.Min("l_quantity", alias="low"), A.Max("l_quantity", alias="high"), A.Mean("l_quantity", alias="mean_raw"), A.Std("l_discount", alias="std_raw"), A.AbsMax("l_discount", alias="most")]
    return A.aggregate_frame(df, *aggs).select("n", "total", "low", "high", F.round("mean_raw", 6).alias("mean"), F.round("std_raw", 6).alias("std"), "most")


@query
def agg_null_policy(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("event_id").cast("double")).alias("v"))
    aggs = [A.Count("v", alias="rows"), A.Count("v", ignore_nulls=True, alias="values"), A.Sum("v", alias="total"), A.Max("v", ignore_nulls=False, alias="poisoned")]
    return A.aggregate_frame(e, *aggs)


@query
def agg_std_ddof(spark, d):
    df = table(spark, d, "customer").select("c_mktsegment", "c_acctbal")
    out = A.aggregate_frame(df, A.Std("c_acctbal", ddof=0, alias="a"), A.Std("c_acctbal", ddof=1, alias="b"), A.Std("c_acctbal", ddof=2, alias="c"), by=["c_mktsegment"])
    return out.select("c_mktsegment", F.round("a", 5).alias("std0"), F.round("b", 5).alias("std1"), F.round("c", 5).alias("std2"))


@query
def agg_abs_max(spark, d):
    return A.aggregate_frame(table(spark, d, "supplier"), A.AbsMax("s_acctbal", alias="most"), by=["s_nationkey"])


@query
def agg_own(spark, d):
    """An own aggregation: the number of distinct event types and the longest properties text."""
    fn = A.AggregateFn("found", lambda: (frozenset(), 0), lambda s, b: (s[0] | frozenset(b.column("event_type").to_pylist()), max(s[1], *map(len, b.column("props").to_pylist()), 0)), lambda x, y: (x[0] | y[0], max(x[1], y[1])), lambda s: (len(s[0]), s[1]))
    got = A.aggregate(table(spark, d, "events").select("event_type", "props"), fn)["found"]
    return spark.createDataFrame([got], "n_types long, longest long")


@query
def reduce_count_sum(spark, d):
    e = table(spark, d, "events")
    return groups.reduce_columns(e, "user_id", {"n": F.count(F.lit(1)), "first_type": groups.first_by("event_type", "event_id"), "last_type": groups.last_by("event_type", "event_id")})


@query
def reduce_ordered_fold(spark, d):
    """A fold that is not associative: each event halves what came before and adds its id."""
    folded = groups.fold_columns(table(spark, d, "events"), "user_id", "event_id", ["event_id"], F.lit(0.0), lambda s, x: s / 2 + x["event_id"].cast("double"))
    return folded.select("user_id", F.round("state", 3).alias("state"))


@query
def reduce_python_fold(spark, d):
    """The same fold in Python."""

    def step(state, row):
        return {"user_id": row["user_id"], "state": (state["state"] / 2 if state else 0.0) + row["event_id"]}

    out = groups.reduce_by_key(table(spark, d, "events").select("user_id", "event_id"), "user_id", step, "user_id long, state double", order=["event_id"])
    return out.select("user_id", F.round("state", 3).alias("state"))


@query
def reduce_python_combine(spark, d):
    """An associative fold in Python: hot keys are folded in pieces and the states combined."""
    out = groups.reduce_by_key(
        table(spark, d, "events").select("event_type", "event_id"), "event_type",
        lambda s, r: {"event_type": r["event_type"], "n": (s["n"] if s else 0) + 1, "x": (s["x"] if s else 0) ^ r["event_id"]},
        "event_type string, n long, x long", combine=lambda a, b: {"event_type": a["event_type"], "n": a["n"] + b["n"], "x": a["x"] ^ b["x"]},
    )
    return out


@query
def group_batches(spark, d):
    got = groups.group_batches(table(spark, d, "events").select("event_type", "event_id"), "event_type", 32, ["event_id"])
    first, last = F.element_at("items", 1)["event_id"], F.element_at("items", -1)["event_id"]
    return got.select("event_type", "group_index", "group_last", F.size("items").alias("n"), first.alias("first_id"), last.alias("last_id"))


@query
def ordered_rank(spark, d):
    """The place of each order among those of its customer, without gathering a customer in one task."""
    return ranking.ordered_rank(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], "place", "orders").select("o_orderkey", F.col("place").cast("long").alias("place"), F.col("orders").cast("long").alias("orders"))


# -- Python callbacks


@query
def map_row(spark, d):
    return rows.map_rows(table(spark, d, "nation"), lambda r: {"key": r["n_nationkey"] * 10, "name": r["n_name"].lower()}, "key long, name string")


@query
def map_bound_output(spark, d):
    return rows.map_bound(table(spark, d, "supplier").select("s_suppkey", "s_name"), lambda s_name: s_name[::-1], ["s_name"], "reversed")


@query
def map_bound_outputs(spark, d):
    return rows.map_bound(table(spark, d, "part").select("p_partkey", "p_size"), lambda p_size: {"half": p_size // 2, "odd": p_size % 2 == 1}, ["p_size"], outputs=["half", "odd"], returns="struct<half:long,odd:boolean>")


@query
def map_catch(spark, d):
    """Rows whose call fails in the expected way are dropped."""
    return rows.map_rows(table(spark, d, "part").select("p_partkey", "p_size"), lambda r: {"p_partkey": r["p_partkey"], "share": 100 // (r["p_size"] % 5)}, "p_partkey long, share long", catch=(ZeroDivisionError,))


@query
def flat_map_tokens(spark, d):
    return rows.flat_map_rows(table(spark, d, "part").select("p_partkey", "p_type"), lambda r: [{"p_partkey": r["p_partkey"], "word": w} for w in r["p_type"].split()], "p_partkey long, word string")


@query
def map_batches_pandas(spark, d):
    return rows.map_batches(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), lambda f: f.assign(o_totalprice=(f["o_totalprice"] / 1000).round(3)), "o_orderkey long, o_totalprice double", 512, "pandas")


@query
def map_batches_arrow(spark, d):
    import pyarrow.compute as pc

    return rows.map_batches(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), lambda t: t.set_column(1, "c_mktsegment", pc.utf8_lower(t["c_mktsegment"])), "c_custkey long, c_mktsegment string", 512, "pyarrow")


@query
def map_async_rows(spark, d):
    async def call(row):
        return None if row["n_nationkey"] % 4 == 0 else [{"key": row["n_nationkey"]}] * (row["n_nationkey"] % 3)

    return rows.map_async(table(spark, d, "nation"), call, "key long", 8)


@query
def bench_cpu_map(spark, d):
    """Two hundred steps of a congruential generator a row, vectorised over Arrow batches, then a reduction."""

    def step(t: pa.Table) -> pa.Table:
        x = t["l_orderkey"].to_numpy().astype(np.uint64)
        for _ in range(200):
            x = (x * np.uint64(1103515245) + np.uint64(12345)) & np.uint64(0x7FFFFFFF)
        return pa.table({"k": t["k"], "x": x.astype(np.int64)})

    df = table(spark, d, "lineitem").select(F.pmod("l_orderkey", F.lit(1000)).alias("k"), "l_orderkey")
    return groups.reduce_columns(rows.map_batches(df, step, "k long, x long", None, "pyarrow"), "k", {"n": F.count(F.lit(1)), "total": F.sum("x")})


# -- vectors


def _knn(spark, d, metric: str, k: int = 5):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    found = vectors.search(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", "vec_id", "embedding", k, metric, skip_self=True)
    return found.select("query_id", "match_id", F.col("rank").cast("long").alias("rank"), F.round("_distance", 4).alias("distance"))


@query
def knn_l2(spark, d):
    return _knn(spark, d, "l2")


@query
def knn_cosine(spark, d):
    return _knn(spark, d, "cosine")


@query
def knn_dot(spark, d):
    return _knn(spark, d, "dot")


@query
def knn_per_row_filter(spark, d):
    e = table(spark, d, "embeddings")
    found = vectors.search(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", "vec_id", "embedding", 3, "l2", where="vec_id >= 10", same=("label", "label"), skip_self=True)
    return found.select("query_id", "match_id", F.col("rank").cast("long").alias("rank"))


@query
def knn_one(spark, d):
    """One query vector as a source: the nearest rows of the table."""
    e = table(spark, d, "embeddings")
    q = [1.0 if i % 2 else -1.0 for i in range(64)]
    return vectors.nearest(e, q, "embedding", 10, "cosine", "label >= 0", "vec_id").select("vec_id", F.round("_distance", 5).alias("distance"))


@query
def ivf_recall(spark, d):
    """Index every vector in cells, search a few of them, and compare with the exact answer: recall of ten neighbours."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    indexed, centres = vectors.index_vectors(e, "vec_id", "embedding", cells=8)
    asked = e.where("vec_id % 100 = 0")
    near = vectors.search_index(asked, indexed, centres, "vec_id", "embedding", "vec_id", "embedding", 10, probes=6)
    exact = vectors.search(asked, e, "vec_id", "embedding", "vec_id", "embedding", 10)
    hits = exact.join(near.select("query_id", "match_id", F.lit(1).alias("hit")), ["query_id", "match_id"], "left")
    return hits.agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


@query
def vector_validate_normalize(spark, d):
    v = vectors.check_embeddings(table(spark, d, "embeddings"), "embedding", 64)
    return v.select("vec_id", "error", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("norm"))


# -- versioned tables


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query
def snap_append_read(spark, d):
    t, o = _table(spark), _orders(spark, d)
    t.commit(o.where("o_orderkey % 2 = 0"), "create")
    t.commit(o.where("o_orderkey % 2 = 1"), "append", expected_version=1)
    return t.read(where="o_totalprice > 150000", columns=["o_orderkey", "o_totalprice"])


@query
def snap_time_travel(spark, d):
    t, o = _table(spark), _orders(spark, d)
    t.commit(o, "create")
    t.commit(o.where("o_orderstatus = 'F'"), "overwrite", expected_version=1)
    old, new = t.read(1), t.read(2)
    return old.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("before")).join(new.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("after")), "o_orderstatus", "left").fillna({"after": 0})


@query
def snap_merge_ignore(spark, d):
    t, o = _table(spark), _orders(spark, d)
    t.commit(o.where("o_orderkey % 3 <> 0"), "create")
    patch = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.lit(None)).otherwise(F.lit("Z")).alias("o_orderstatus"))
    t.merge(patch, "o_orderkey", when_not_matched="ignore")
    return t.read()


@query
def snap_merge_insert(spark, d):
    t, o = _table(spark), _orders(spark, d)
    t.commit(o.where("o_orderkey % 3 <> 0"), "create")
    t.merge(o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit(1.0).alias("o_totalprice")), ["o_orderkey"], when_not_matched="insert")
    return t.read()


@query
def snap_add_columns(spark, d):
    t, o = _table(spark), _orders(spark, d)
    t.commit(o, "create")
    t.add_columns("note string", expected_version=1)
    t.merge(o.where("o_totalprice > 300000").select("o_orderkey", F.lit("large").alias("note")), "o_orderkey")
    return t.read(columns=["o_orderkey", "note"])


@query
def checkpoint_replay(spark, d):
    """The first run is stored; a second one with the same version reads it and does not compute."""
    path = f"{scratch_root(spark)}/weftline/c-{uuid.uuid4().hex}"
    sinks.checkpoint(table(spark, d, "region"), path, "1")
    return sinks.checkpoint(table(spark, d, "region").limit(0), path, "1")


@query
def row_digests(spark, d):
    """Distinct rows have distinct digests, and equal rows equal ones."""
    o = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_linenumber")
    return row_digest(o).agg(F.countDistinct("digest").alias("n"))


# -- stateful steps


@query
def dedup_first_arrival(spark, d):
    return stateful.first_arrivals(table(spark, d, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id")


@query
def admit_single_quota(spark, d):
    return stateful.admit_quota(table(spark, d, "events").select("event_id", "user_id"), ["user_id"], 3, ["event_id"])


@query
def admit_multi_quota(spark, d):
    """Duplicates by user and type, and two quotas, decided in order of arrival."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return stateful.admit_rows(e, ["user_id", "event_type"], {"user_id": 2, "event_type": 150}, ["event_id"])


@query
def lookup_join(spark, d):
    n = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    got = stateful.lookup(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), n, "s_nationkey", "found")
    return got.select("s_suppkey", F.col("found.hit").alias("hit"), F.col("found.value").alias("name"))


@query
def lookup_matches_list(spark, d):
    got = stateful.lookup_list(table(spark, d, "region"), table(spark, d, "nation"), {"r_regionkey": "n_regionkey"}, ["n_name"], "nations", 10)
    return got.select("r_name", F.array_join(F.transform("nations", lambda x: x["n_name"]), ",").alias("nations"))


@query
def remaining_quota(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return stateful.remaining(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey")), c, "c_nationkey", 70)


@query
def map_cached_values(spark, d):
    got = stateful.map_cached(table(spark, d, "part").select("p_partkey", "p_brand"), lambda b: b.upper() + "!", ["p_brand"], "shout", "string", _table(spark), "1")
    return got.select("p_partkey", "shout")


@query
def events_dedup_stream(spark, d):
    """The events as a stream, first arrivals only, into a versioned table; each batch once."""
    t, work = _table(spark), f"{scratch_root(spark)}/weftline/s-{uuid.uuid4().hex}"
    src = streams.read_stream(spark, d, table(spark, d, "events").schema, pattern="events.parquet")
    streams.run_stream(streams.stream_deduplicate(src, ["user_id", "event_type"]).select("user_id", "event_type"), streams.save_batches(t, "dedup"), work)
    return t.read()


@query
def queue_records(spark, d):
    """Messages in, some answered: what is still open, by sequence number."""
    q = streams.MessageQueue(spark, f"{scratch_root(spark)}/weftline/q-{uuid.uuid4().hex}")
    n = table(spark, d, "nation").select(F.format_string("n%02d", "n_nationkey").alias("id"), F.col("n_name").alias("value"))
    q.enqueue(n, "id", "value")
    q.ack(n.where("id < 'n10'"), "id", "value")
    return q.open_tasks().select("sequence", "task_id", "value")


@query
def components(spark, d):
    """Connected groups of suppliers that share a part ordered fifty at a time."""
    line = table(spark, d, "lineitem").where("l_quantity >= 50").select("l_partkey", "l_suppkey").distinct()
    least = line.groupBy("l_partkey").agg(F.min("l_suppkey").alias("a"))
    return connected_components(line.join(least, "l_partkey").select("a", F.col("l_suppkey").alias("b")))


# -- text and pages


@query
def terms_overlap_rank(spark, d):
    """Blocks ranked for three questions by common terms."""
    ids = table(spark, d, "documents").select(F.col("id").alias("document_id"), "doc_id")
    b = table(spark, d, "blocks").dropDuplicates(["document_id", "position"]).join(ids, "document_id").select("doc_id", "position", "kind", "headings", "text")
    q = spark.createDataFrame([(1, "copper bridge near the river"), (2, "restored chapel wheel"), (3, "Who repaired the old mill?")], "question_id int, text string")
    ranked = text.rank_blocks(b, q, ["doc_id", "position"], min_matches=2)
    return ranked.where("rank <= 3").select("question_id", "doc_id", "position", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def read_documents(spark, d):
    """The same, admitted within a budget of characters."""
    ids = table(spark, d, "documents").select(F.col("id").alias("document_id"), "doc_id")
    b = table(spark, d, "blocks").dropDuplicates(["document_id", "position"]).join(ids, "document_id").select("doc_id", "position", "kind", "headings", "text")
    q = spark.createDataFrame([(1, "restored chapel wheel with brittle copper"), (2, "puente de cobre")], "question_id int, text string")
    ranked = text.rank_blocks(b, q, ["doc_id", "position"], min_matches=3).join(b.select("doc_id", "position", F.length("text").alias("size")), ["doc_id", "position"])
    return text.admit_blocks(ranked, "size", 20_000, "doc_id").where("admitted").groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("used"))


@query
def position_ranges(spark, d):
    ids = table(spark, d, "documents").select(F.col("id").alias("document_id"), "doc_id")
    b = table(spark, d, "blocks").where("kind = 'list_item'").join(ids, "document_id")
    return text.position_ranges(b, "doc_id", "position").select("doc_id", F.array_join("ranges", " ").alias("ranges"))


@query
def json_props_extract(spark, d):
    e = W.Dataset(table(spark, d, "events").select("event_id", "props"))
    return e.add_column("k", F.get_json_object("props", "$.k").try_cast("long")).filter("k > 50").drop_columns("props").df


@query
def located_records(spark, d):
    """Lines with their file and number, bad ones kept: written from the nations and read again."""
    path = f"{scratch_root(spark)}/weftline/r-{uuid.uuid4().hex}"
    n = table(spark, d, "nation")
    line = F.when(F.col("n_nationkey") % 6 == 0, F.lit("not json")).otherwise(F.to_json(F.struct(F.col("n_nationkey").alias("id"))))
    n.orderBy("n_nationkey").coalesce(1).select(line).write.text(path)
    got = readers.read_records(path, schema="id long", spark=spark)
    return got.select("row", F.coalesce("value.id", F.lit(-1)).cast("long").alias("id"), F.col("error").isNotNull().alias("bad"))


@query
def html_blocks(spark, d):
    """Pages made of titles and texts, parsed into blocks, counted by kind."""
    b = table(spark, d, "nation")
    page = F.concat(F.lit("<nav><a>x</a></nav><main><h1>"), "n_name", F.lit("</h1><p>one <b>two</b></p><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></main><footer>f</footer>"))
    got = page_blocks(b.select("n_nationkey", page.alias("page")), "page")
    return got.select(F.explode("blocks").alias("b")).groupBy(F.col("b.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.max("b.text").alias("last_text"))


@query
def url_normalize(spark, d):
    return table(spark, d, "urls").select("url", urls.normalize_url(F.col("url")).alias("normal")).distinct()


@query
def url_policy(spark, d):
    reason = urls.url_policy(F.col("url"), ["kelmora.example"], [{"name": "keep", "action": "allow", "path_pattern": "^/view"}, {"name": "dated", "action": "exclude", "path_pattern": r"^/\d{4}/"}])
    return table(spark, d, "urls").select(reason.alias("reason")).groupBy(F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query
def prompt_render(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", render(n, "Nation {{ n_name }} has key {{n_nationkey|json}}.").alias("prompt"))


@query
def prompt_journal_reuse(spark, d):
    """Asked twice over a journal: the second run reuses every answer."""
    t, o = _table(spark), table(spark, d, "orders").select("o_orderpriority")
    a = map_prompt(o, "Explain {{o_orderpriority}}", EchoClient(), journal=t, schema={"type": "object", "required": ["answer"], "properties": {"answer": {"type": "string"}}})
    b = map_prompt(o, "Explain {{o_orderpriority}}", EchoClient(), journal=t, schema={"type": "object", "required": ["answer"], "properties": {"answer": {"type": "string"}}})
    return a.unionByName(b).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("answer").alias("answers"), F.count("error").alias("errors"))


@query
def embed_hash_projection(spark, d):
    got = map_embeddings(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", HashEncoder(16), 16)
    return got.select("p_partkey", F.size("embedding").alias("dim"), "error")


@query
def spans(spark, d):
    got = document_spans(table(spark, d, "documents").select("doc_id", "text"), "text", 200, 20)
    return got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query
def read_own_source(spark, d):
    """An own source of several tasks."""

    class Numbers(readers.Source):
        schema = "task long, n long"

        def get_read_tasks(self, parallelism):
            return [readers.ReadTask(lambda i=i: [[{"task": i, "n": j} for j in range(i)]]) for i in range(6)]

    return readers.read_datasource(Numbers(), spark=spark)


@query
def write_own_sink(spark, d):
    """An own sink: the rows that its tasks report."""

    class Counting(sinks.Sink):
        def write(self, blocks, partition):
            return sum(b.num_rows for b in blocks)

    done = sinks.write_datasink(table(spark, d, "customer"), Counting())
    return spark.createDataFrame([(sum(r.value for r in done), sum(r.rows for r in done))], "reported long, n long")


@query
def csv_round_trip(spark, d):
    path = f"{scratch_root(spark)}/weftline/csv-{uuid.uuid4().hex}"
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("k"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit('a "q", '), "n_name", F.lit("\nb"))).alias("v"))
    sinks.write_csv(n, path)
    return readers.read_csv(path, spark=spark)


@query
def json_round_trip(spark, d):
    path = f"{scratch_root(spark)}/weftline/json-{uuid.uuid4().hex}"
    sinks.write_json(table(spark, d, "region"), path)
    return readers.read_json(path, schema="r_regionkey int, r_name string", spark=spark)


@query
def sample_rows(spark, d):
    """A Bernoulli sample of every tenth row or so: its size lies near the mean."""
    line = W.Dataset(table(spark, d, "lineitem"))
    n, all_ = line.random_sample(0.1, 7).count(), line.count()
    return spark.createDataFrame([(abs(n - all_ / 10) < 5 * (all_ * 0.09) ** 0.5,)], "near boolean")


@query
def shuffle_rows(spark, d):
    """Another order, the same rows."""
    return W.Dataset(table(spark, d, "supplier")).random_shuffle(3).df.agg(F.count(F.lit(1)).alias("n"), F.sum("s_suppkey").alias("keys"))
