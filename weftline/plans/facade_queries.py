"""Registered queries that go through the methods of ``Dataset``: one for each operator that the others leave out."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import dataset as W
from weftline.functions import embeddings, html, images, jsonschema, text
from weftline.functions.urls import normalize_url
from weftline.operators import vectors
from weftline.operators.keys import json_order
from weftline.session import execution, scratch_root, table
from weftline.snapshot.catalog import Catalog, Releases, pin
from weftline.snapshot.stores import Library, append_new
from weftline.snapshot.table import VersionedTable
from weftline.sources import readers, sinks
from weftline.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _of(spark: SparkSession, d: str, name: str, *columns: str) -> W.Dataset:
    df = table(spark, d, name)
    return W.Dataset(df.select(*columns) if columns else df)


def _uri(spark: SparkSession, kind: str) -> str:
    return f"{scratch_root(spark)}/weftline/{kind}-{uuid.uuid4().hex}"


# -- data from the driver


@query
def items(spark, d):
    return W.from_items([{"k": i, "square": i * i} for i in range(50)], "k long, square long", spark).df


@query
def iterator_rows(spark, d):
    return W.from_iter(lambda: ({"k": i, "word": "x" * (i % 4)} for i in range(3000)), "k long, word string", spark).df


@query
def range_rows(spark, d):
    return W.range(1000, spark).df


@query
def arrow_rows(spark, d):
    t = pa.table({"k": pa.array([1, 2, None], pa.int64()), "word": ["a", None, "c"]})
    return W.from_arrow([t, t.slice(1)], spark).df


@query
def numpy_rows(spark, d):
    got = W.from_numpy([np.arange(4, dtype=np.int64), np.array([10, 20], dtype=np.int64)], spark).df
    return got.select(F.col("data").cast("long").alias("data"))


@query
def pandas_rows(spark, d):
    return W.from_pandas([pd.DataFrame({"k": [1, 2]}), pd.DataFrame({"k": [3]})], spark).df


# -- files


@query
def text_lines(spark, d):
    """Names written as lines, with blank ones between, and read again."""
    path = _uri(spark, "text")
    table(spark, d, "part").select(F.when(F.col("p_partkey") % 5 == 0, F.lit("")).otherwise(F.col("p_name"))).write.text(path)
    return W.read_text(path, spark=spark).df


@query
def binary_files(spark, d):
    """Size and hash of a file of bytes."""
    path = _uri(spark, "bytes")
    table(spark, d, "nation").orderBy("n_nationkey").coalesce(1).select("n_name").write.text(path)
    got = readers.read_binary_files(f"{path}/part-*", spark=spark)
    return got.select(F.length(got.columns[0]).cast("long").alias("size"), F.sha2(got.columns[0], 256).alias("hash"))


@query
def json_document(spark, d):
    """One JSON array in a file, not lines."""
    path = _uri(spark, "array")
    n = table(spark, d, "nation").agg(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))))
    n.coalesce(1).write.text(path)
    return W.read_json(path, lines=False, schema="n_nationkey int, n_name string", spark=spark).df


@query
def parquet_with_paths(spark, d):
    got = W.read_parquet([f"{d}/nation.parquet", f"{d}/nation.parquet"], columns=["n_nationkey"], where="n_nationkey < 10", include_paths=True, spark=spark).df
    return got.select("n_nationkey", F.element_at(F.split("path", "/"), -1).alias("file"))


# -- columns and order


@query
def select_drop_rename(spark, d):
    o = _of(spark, d, "orders").select_columns(["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])
    return o.drop_columns("o_custkey").rename_columns({"o_orderkey": "id"}).rename_columns(["id", "status", "price"]).df


@query
def sort_columns(spark, d):
    """The hundred last by two keys in two directions."""
    return _of(spark, d, "lineitem", "l_returnflag", "l_orderkey", "l_linenumber").sort(["l_returnflag", "l_orderkey", "l_linenumber"], descending=[True, False, True]).limit(100).df


@query
def sort_ranges(spark, d):
    """A range sort: each row is followed by a larger key, across partitions too."""
    s = _of(spark, d, "customer", "c_custkey").sort("c_custkey", boundaries=5).df
    at = s.select("c_custkey", F.spark_partition_id().alias("p"))
    bounds = at.groupBy("p").agg(F.min("c_custkey").alias("low"), F.max("c_custkey").alias("high"), F.count(F.lit(1)).alias("n"))
    later = bounds.select(F.col("p").alias("q"), F.col("low").alias("next"))
    return bounds.join(later, F.col("q") > F.col("p"), "left").agg(F.sum(F.when(F.col("next") <= F.col("high"), 1).otherwise(0)).alias("overlaps"), F.countDistinct("p").alias("ranges"))


@query
def repartition_rows(spark, d):
    """The same rows in twelve partitions, equal keys together."""
    r = _of(spark, d, "lineitem", "l_orderkey", "l_linenumber").repartition(num_blocks=12, keys=["l_orderkey"], sort=True).df
    return r.withColumn("p", F.spark_partition_id()).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p").alias("partitions"))


@query
def shuffled_rows(spark, d):
    return _of(spark, d, "supplier", "s_suppkey", "s_name").random_shuffle(3).df


@query
def shuffled_blocks(spark, d):
    return _of(spark, d, "customer", "c_custkey", "c_acctbal").repartition(num_blocks=6).randomize_block_order(5).df


@query
def sampled_rows(spark, d):
    """All rows by a fraction of one, none by zero; and a tenth lies near the mean and holds no row more often than the table."""
    c = _of(spark, d, "lineitem", "l_orderkey", "l_linenumber")
    n = c.count()
    tenth = c.random_sample(0.1, 7).df.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("x"))
    held = c.df.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("y"))
    more = tenth.join(held, ["l_orderkey", "l_linenumber"], "left")
    some = more.agg(F.count_if(F.col("y").isNull() | (F.col("x") > F.col("y"))).alias("invented"), (F.abs(F.sum("x") - n / 10) < 5 * (n * 0.09) ** 0.5).alias("near"))
    return c.random_sample(1.0, 1).union(c.random_sample(0.0, 1)).df.agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys")).crossJoin(some)  # one row each


# -- results


@query
def global_numbers(spark, d):
    """The short forms of the aggregates."""
    c = _of(spark, d, "customer", "c_custkey", "c_acctbal")
    row = (c.count(), c.sum("c_custkey"), c.min("c_acctbal"), c.max("c_acctbal"), round(c.mean("c_custkey"), 6), round(c.std("c_custkey"), 4))
    return spark.createDataFrame([row], "n long, total long, low double, high double, mean double, std double")


@query
def taken_rows(spark, d):
    """take, take_all, take_batch and the iterators give the same rows of a sorted table."""
    n = _of(spark, d, "nation", "n_nationkey", "n_name").sort("n_nationkey")
    got = [n.take(7), n.take_all(100)[:7], n.take_batch(7, "pandas").to_dict("records"), [r for r, _ in zip(n.iter_rows(), range(7))], next(iter(n.iter_batches(7))).to_pylist()]
    return spark.createDataFrame([(i, r["n_nationkey"], r["n_name"]) for i, rows in enumerate(got) for r in rows], "way int, n_nationkey long, n_name string")


@query
def materialized(spark, d):
    with _of(spark, d, "part", "p_partkey", "p_size").filter("p_size > 20").materialize() as m:
        return spark.createDataFrame([(m.count(), m.columns(), m.num_blocks() > 0, m.size_bytes() > 0)], "n long, names array<string>, blocks boolean, bytes boolean").withColumn("names", F.array_join("names", ","))


@query
def run_settings(spark, d):
    """Settings inside a block, and what they are afterwards."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with execution(spark, partitions=3):
        inside = _of(spark, d, "nation").execution_metadata()["partitions"]
    return spark.createDataFrame([(inside, spark.conf.get("spark.sql.shuffle.partitions") == before)], "inside string, restored boolean")


@query
def sql_over_datasets(spark, d):
    o = _of(spark, d, "orders", "o_custkey", "o_totalprice").filter("o_totalprice > 100000")
    return W.sql("SELECT c_mktsegment, count(*) AS n FROM {o} JOIN {c} ON o_custkey = c_custkey GROUP BY c_mktsegment", spark, o=o, c=_of(spark, d, "customer")).df


@query
def json_keys(spark, d):
    """Canonical JSON of two columns, ordered by the JSON of a key."""
    n = text.canonical_json(table(spark, d, "nation"), ["n_regionkey", "n_name"], "doc")
    return n.orderBy(json_order(n, ["n_nationkey"])).select("n_nationkey", "doc")


# -- versioned tables


@query
def table_upkeep(spark, d):
    """Append, consolidate, retire and clone: the rows of the clone; lost commits are found by their operation."""
    o, t = table(spark, d, "orders").select("o_orderkey", "o_totalprice"), VersionedTable(spark, _uri(spark, "t"))
    t.commit(o.where("o_orderkey % 3 = 0"), "create", operation_id="first")
    t.commit(o.where("o_orderkey % 3 = 1"), "append", operation_id="second")
    t.consolidate(2)
    t.commit(o.where("o_orderkey % 3 = 2"), "append")
    t.retire(keep=1)
    copy = _uri(spark, "copy")
    t.clone(copy)
    held = t.find("second")
    return W.read_table(copy, spark=spark).df.withColumn("found", F.lit(held.version if held else None).cast("int")).withColumn("versions", F.lit(len(t.history())))


@query
def table_inspected(spark, d):
    uri = _uri(spark, "t")
    receipt = _of(spark, d, "customer", "c_custkey", "c_name").write_table(uri)
    seen = readers.inspect_table(uri, spark=spark)
    return spark.createDataFrame([(receipt.rows, seen["rows"], seen["version"], ",".join(seen["fields"]))], "written long, rows long, version int, fields string")


@query
def checkpoint_of_plan(spark, d):
    """A checkpoint under the fingerprint of its plan: the same plan reads it again."""
    uri = _uri(spark, "cp")
    make = lambda: _of(spark, d, "supplier", "s_suppkey", "s_nationkey").filter("s_nationkey < 5")
    make().checkpoint_table(uri)
    got = make().checkpoint_table(uri).df
    return got.withColumn("versions", F.lit(VersionedTable(spark, uri).head()))


@query
def key_values(spark, d):
    """Later puts replace earlier values, and of one put the last by its order."""
    kv = sinks.KeyValueSink(VersionedTable(spark, _uri(spark, "kv")))
    e = table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("value"), "event_id")
    kv.put(e.where("event_id % 2 = 0"), order="event_id")
    kv.put(e.where("event_id % 3 = 0"), order="event_id")
    return kv.table.read()


@query
def registers(spark, d):
    """A pinned table in the catalogue and in a release, opened after the table went on."""
    uri = _uri(spark, "t")
    _of(spark, d, "region").write_table(uri)
    ref = pin(spark, "regions", uri)
    Catalog(spark, f"{uri}-catalog").register(ref)
    Releases(spark, f"{uri}-releases").register("r1", [ref])
    _of(spark, d, "region").write_table(uri, "append")
    held = Releases(spark, f"{uri}-releases").open("r1")["regions"]
    return W.read_table(held.uri, version=held.version, spark=spark).df.withColumn("known", F.lit(Catalog(spark, f"{uri}-catalog").get("regions") == held))


@query
def content_store(spark, d):
    """Brands by their hash, appended twice: each once."""
    p = table(spark, d, "part").select(F.sha2("p_brand", 256).alias("key"), F.col("p_brand").alias("value"))
    t = VersionedTable(spark, _uri(spark, "cas"))
    append_new(t, p.where("p_partkey % 2 = 0"), "key")
    append_new(t, p, "key")
    return t.read(columns=["value"])


@query
def document_library(spark, d):
    """The document of every address, whatever its form: the least where several share one."""
    lib = Library(spark, _uri(spark, "lib"))
    u = table(spark, d, "urls").select(normalize_url(F.col("url")).alias("url"), "document_id").where("url IS NOT NULL AND document_id IS NOT NULL")
    lib.register(table(spark, d, "documents").select("id", "parser"), u.groupBy("url").agg(F.min("document_id").alias("document_id")))
    return lib.resolve(table(spark, d, "urls").select("url").distinct())


@query
def manifest_counts(spark, d):
    return sinks.scan_counts(table(spark, d, "lineitem"), "l_returnflag")


@query
def unfinished_rows(spark, d):
    return sinks.checkpoint_filter(table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey")


# -- queues and streams


@query
def queue_results(spark, d):
    """Messages up to a high-water mark with the answers that are there."""
    uri = _uri(spark, "q")
    n = _of(spark, d, "nation").add_column("id", F.format_string("n%02d", "n_nationkey"))
    n.enqueue(uri, "id", "n_name")
    n.filter("n_nationkey >= 15").ack_queue(uri, "id", "n_name")
    return W.read_queue(uri, through=18, results=True, spark=spark).df.select("sequence", "task_id", "value", F.col("result").isNotNull().alias("done"))


@query
def stream_merged(spark, d):
    """Events as a stream, merged by user: every user once, though the input is read twice."""
    uri, work = _uri(spark, "s"), _uri(spark, "w")
    for _ in range(2):
        src = streams.read_stream(spark, d, table(spark, d, "events").schema, pattern="events.parquet").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
        streams.run_stream(src, lambda b, i: streams.save_batches(VersionedTable(spark, uri), "users", "merge", ["user_id"])(b, i), work, mode="update")
    return W.read_table(uri, spark=spark).df


# -- pages, images, text


@query
def micro_batches(spark, d):
    """Batches of at most 16 rows; the call that fails on a batch leaves its rows to the dead ones."""
    got = _of(spark, d, "customer", "c_custkey").batch_map(lambda t: t.append_column("twice", pa.array([2 * x for x in t["c_custkey"].to_pylist()])), "c_custkey long, twice long", 16, "pyarrow")
    return got.df


@query
def vector_source(spark, d):
    """The nearest rows of a versioned table by one vector, the filter first."""
    uri = _uri(spark, "v")
    _of(spark, d, "embeddings", "vec_id", "label", "embedding").write_table(uri)
    got = readers.vector_search(uri, [1.0 if i % 2 else -1.0 for i in range(64)], "embedding", 10, "l2", where="label >= 2", columns=["vec_id", "label"], spark=spark)
    return got.select("vec_id", F.round("_distance", 4).alias("distance"))


@query
def image_sizes(spark, d):
    """Width and height from the headers of images of four formats, made from a key."""
    n = table(spark, d, "nation")
    w, h = F.col("n_nationkey") + 3, F.col("n_nationkey") * 2 + 5
    le = lambda c, k: F.concat(*[F.substring(F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0")), 4 - i, 1) for i in range(k)])
    be = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0"))
    raw = lambda s: F.unhex(F.lit(s))
    made = {
        "png": F.concat(raw("89504E470D0A1A0A0000000D49484452"), be(w), be(h), raw("0802000000")),
        "gif": F.concat(raw("474946383961"), le(w, 2), le(h, 2), raw("000000000000000000")),
        "bmp": F.concat(raw("424D000000000000000000000000"), raw("28000000"), le(w, 4), le(h, 4), raw("0100180000000000")),
        "bmp_core": F.concat(raw("424D000000000000000000000000"), raw("0C000000"), le(w, 2), le(h, 2), raw("01001800000000")),
    }
    every = n.select("n_nationkey", F.explode(F.array(*[F.struct(F.lit(k).alias("made"), v.alias("data")) for k, v in made.items()])).alias("x")).select("n_nationkey", "x.made", "x.data")
    got = images.image_sizes(every, "data")
    return got.select("n_nationkey", "made", F.col("image.width").cast("long").alias("width"), F.col("image.height").cast("long").alias("height"))


@query
def image_limits(spark, d):
    """Declared sizes and types against the limits, before anything is fetched."""
    p = table(spark, d, "part").select("p_partkey", "p_size", F.element_at(F.array(F.lit("image/png"), F.lit("image/GIF"), F.lit(None).cast("string")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("mime"))
    why = embeddings.image_preflight("p_size", "mime", "p_size", "p_size", 40, ["image/png"], 10, 200)
    return p.select("p_partkey", F.coalesce(why, F.lit("")).alias("reason"))


@query
def objects_verified(spark, d):
    """Bytes against a hash that is wrong for every seventh."""
    p = table(spark, d, "part").select("p_partkey", F.encode("p_name", "utf-8").alias("body"), F.when(F.col("p_partkey") % 7 == 0, F.lit("00")).otherwise(F.sha2("p_name", 256)).alias("hash"))
    return embeddings.verify_objects(p, "body", "hash", 1 << 20).select("p_partkey", "status")


@query
def answers_checked(spark, d):
    """Answers against a closed schema: each with the number of its faults."""
    schema = jsonschema.check_schema({"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "exclusiveMaximum": 50}, "name": {"type": ["string", "null"], "maxLength": 6}}})
    p = table(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.col("p_size").alias("k"), F.col("p_brand").alias("name"), F.when(F.col("p_partkey") % 4 == 0, F.lit(1)).alias("more"))).alias("answer"))

    def faults(answer: str) -> int:
        return len(jsonschema.errors_of(json.loads(answer), schema))

    return W.Dataset(p).map(faults, inputs=["answer"], output="faults", returns="long").df.select("p_partkey", "faults")


@query
def page_bodies_by_markup(spark, d):
    """Pages with widgets, a short article and a long one, and a declared encoding: what is kept."""
    name = F.col("n_name")
    body = F.encode(
        F.concat(
            F.lit("<html><head><meta charset=utf-8><title>"), name, F.lit("</title></head><body><div class='sidebar'><p>aside</p></div><article><p>teaser</p></article><article class='has-sidebar'><h1>"),
            name, F.lit("</h1><p>Body é of "), name, F.lit("</p><ul><li>one<li>two</ul></article><div class='cookie-notice'>We store</div>"),
        ),
        "utf-8",
    )
    got = W.Dataset(table(spark, d, "nation").select("n_nationkey", body.alias("page"))).parse_pages("page").df
    return got.select("n_nationkey", F.array_join(F.transform("blocks", lambda b: b["text"]), "|").alias("texts"))


@query
def page_encodings(spark, d):
    """One word in several encodings, by mark, header and declaration."""
    cases = [
        ("mark", b"\xff\xfe" + "<p>żółw</p>".encode("utf-16-le"), "text/html; charset=latin1"), ("header", "<p>żółw</p>".encode("iso8859-2"), "text/html; charset=ISO-8859-2"),
        ("declared", b"<head><meta http-equiv=Content-Type content='text/html; charset=windows-1250'></head>" + "<p>żółw</p>".encode("cp1250"), "text/html"), ("default", "<p>żółw</p>".encode(), "text/html"),
        ("comment", b"<!-- <meta charset=koi8-r> -->" + "<p>żółw</p>".encode(), "text/html"), ("plain", "żółw\n\nx".encode(), "text/plain"),
    ]
    df = spark.createDataFrame(cases, "kind string, body binary, type string")
    return html.page_blocks(df, "body", "type").select("kind", F.element_at("blocks", 1)["text"].alias("text"))


@query
def sections(spark, d):
    """Sections of the documents by their first headings: blocks up to the next heading of that level."""
    b = table(spark, d, "blocks").dropDuplicates(["document_id", "block_id"]).select("document_id", "block_id", "position", "kind", "heading_level")
    heads = b.where("kind = 'heading' AND heading_level = 1").groupBy("document_id").agg(F.min_by("block_id", "position").alias("block_id"))
    return text.section_blocks(b, heads).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"), F.max("position").alias("last"))


@query
def hash_embeddings(spark, d):
    """Each vector of the offline encoder: its length, and equal texts have equal vectors."""
    p = _of(spark, d, "part", "p_partkey", "p_brand").map_embeddings("p_brand", embeddings.HashEncoder(16), 16).df
    squares = F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4)
    return p.groupBy("p_brand").agg(F.countDistinct("embedding").alias("vectors"), F.max(squares).alias("square"), F.max(F.size("embedding")).alias("dim"))


@query
def digests_of_rows(spark, d):
    """The digest of a row is that of its content, whatever the order of columns: distinct rows and distinct digests of both."""
    from weftline.snapshot.digests import row_digest

    o = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_linenumber")
    a, b = row_digest(o).select("digest"), row_digest(o.select("l_linenumber", "l_quantity", "l_linestatus", "l_returnflag")).select("digest")
    return a.agg(F.countDistinct("digest").alias("n")).crossJoin(a.unionByName(b).agg(F.countDistinct("digest").alias("of_both")))  # one row each


@query
def vectors_checked(spark, d):
    """Vectors spoilt in four ways, and what is said of each."""
    e, v = table(spark, d, "embeddings").select("vec_id", "embedding"), F.col("embedding")
    kind = F.pmod("vec_id", F.lit(5))
    spoilt = (
        F.when(kind == 1, F.lit(None))
        .when(kind == 2, F.slice(v, 1, 63))
        .when(kind == 3, F.concat(F.slice(v, 1, 63), F.array(F.lit(float("nan")).cast("float"))))
        .when(kind == 4, F.transform(v, lambda x: x * F.lit(0.0).cast("float")))
        .otherwise(v)
    )
    got = vectors.check_embeddings(e.withColumn("embedding", spoilt.cast("array<float>")), "embedding", 64)
    return got.select("vec_id", F.coalesce("error", F.lit("")).alias("error"), F.col("embedding").isNotNull().alias("kept"))


@query
def index_recall_bound(spark, d):
    """The neighbours that an index over all vectors was asked for, and whether nine of ten were found."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    indexed, centres = vectors.index_vectors(e, "vec_id", "embedding", cells=8)
    asked = e.where("vec_id % 100 = 0")
    near = vectors.search_index(asked, indexed, centres, "vec_id", "embedding", "vec_id", "embedding", 10, probes=6)
    exact = vectors.search(asked, e, "vec_id", "embedding", "vec_id", "embedding", 10)
    hits = exact.join(near.select("query_id", "match_id", F.lit(1).alias("hit")), ["query_id", "match_id"], "left")
    return hits.agg(F.count(F.lit(1)).alias("n"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("enough"))
