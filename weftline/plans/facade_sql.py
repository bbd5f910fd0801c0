"""SQL twins of the queries in ``facade_queries``, over the same tables."""

from __future__ import annotations

from weftline.plans import reference_sql

_FIFTY = "generate_series(0, 49)"

SQL: dict[str, str] = {
    "items": f"SELECT k, k * k AS square FROM {_FIFTY} t(k)",
    "iterator_rows": "SELECT k, repeat('x', CAST(k % 4 AS INTEGER)) AS word FROM generate_series(0, 2999) t(k)",
    "range_rows": "SELECT id FROM generate_series(0, 999) t(id)",
    "arrow_rows": "SELECT CAST(k AS BIGINT) AS k, word FROM (VALUES (1, 'a'), (2, NULL), (NULL, 'c'), (2, NULL), (NULL, 'c')) t(k, word)",
    "numpy_rows": "SELECT CAST(data AS BIGINT) AS data FROM (VALUES (0), (1), (2), (3), (10), (20)) t(data)",
    "pandas_rows": "SELECT CAST(k AS BIGINT) AS k FROM (VALUES (1), (2), (3)) t(k)",
    "text_lines": "SELECT p_name AS text FROM part WHERE p_partkey % 5 <> 0",
    "binary_files": "SELECT CAST(strlen(t) AS BIGINT) AS size, sha256(t) AS hash FROM (SELECT string_agg(n_name || chr(10), '' ORDER BY n_nationkey) AS t FROM nation)",
    "json_document": "SELECT n_nationkey, n_name FROM nation",
    "parquet_with_paths": "SELECT n_nationkey, 'nation.parquet' AS file FROM nation, generate_series(1, 2) WHERE n_nationkey < 10",
    "select_drop_rename": "SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders",
    "sort_columns": "SELECT l_returnflag, l_orderkey, l_linenumber FROM lineitem ORDER BY l_returnflag DESC, l_orderkey, l_linenumber DESC LIMIT 100",
    "sort_ranges": "SELECT CAST(0 AS BIGINT) AS overlaps, CAST(5 AS BIGINT) AS ranges",
    "repartition_rows": "SELECT l_orderkey, count(*) AS n, CAST(1 AS BIGINT) AS partitions FROM lineitem GROUP BY l_orderkey",
    "shuffled_rows": "SELECT s_suppkey, s_name FROM supplier",
    "shuffled_blocks": "SELECT c_custkey, c_acctbal FROM customer",
    "sampled_rows": "SELECT count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys, CAST(0 AS BIGINT) AS invented, true AS near FROM lineitem",
    "global_numbers": "SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS total, min(c_acctbal) AS low, max(c_acctbal) AS high, round(avg(c_custkey), 6) AS mean, round(stddev_samp(c_custkey), 4) AS std FROM customer",
    "taken_rows": "SELECT CAST(way AS INTEGER) AS way, CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 7), generate_series(0, 4) w(way)",
    "materialized": "SELECT count(*) AS n, 'p_partkey,p_size' AS names, true AS blocks, true AS bytes FROM part WHERE p_size > 20",
    "run_settings": "SELECT '3' AS inside, true AS restored",
    "sql_over_datasets": "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY c_mktsegment",
    "json_keys": """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_regionkey":' || CAST(n_regionkey AS VARCHAR) || '}' AS doc FROM nation""",
    "table_upkeep": "SELECT o_orderkey, o_totalprice, CAST(2 AS INTEGER) AS found, CAST(1 AS INTEGER) AS versions FROM orders",
    "table_inspected": "SELECT count(*) AS written, count(*) AS rows, CAST(1 AS INTEGER) AS version, 'c_custkey,c_name' AS fields FROM customer",
    "checkpoint_of_plan": "SELECT s_suppkey, s_nationkey, CAST(1 AS INTEGER) AS versions FROM supplier WHERE s_nationkey < 5",
    "key_values": """SELECT event_type AS key, CAST(coalesce(max(CASE WHEN event_id % 3 = 0 THEN event_id END), max(CASE WHEN event_id % 2 = 0 THEN event_id END)) AS VARCHAR) AS value
FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0 GROUP BY event_type""",
    "registers": "SELECT r_regionkey, r_name, true AS known FROM region",
    "content_store": "SELECT DISTINCT p_brand AS value FROM part",
    "document_library": f"""WITH nu AS ({reference_sql.SQL["url_normalize"]}),
a AS (SELECT normal, min(document_id) AS document_id FROM nu JOIN urls USING (url) WHERE document_id IS NOT NULL AND normal IS NOT NULL GROUP BY normal)
SELECT nu.url, a.document_id FROM nu LEFT JOIN a USING (normal)""",
    "manifest_counts": "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    "unfinished_rows": "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IS NULL OR c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "queue_results": "SELECT CAST(n_nationkey + 1 AS BIGINT) AS sequence, 'n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS task_id, n_name AS value, n_nationkey >= 15 AS done FROM nation WHERE n_nationkey < 18",
    "stream_merged": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id",
    "micro_batches": "SELECT c_custkey, 2 * c_custkey AS twice FROM customer",
    "vector_source": """SELECT vec_id, round(dist, 4) AS distance FROM (
  SELECT vec_id, list_sum(list_transform(range(64), lambda i: pow(CAST(embedding[i + 1] AS DOUBLE) - (CASE WHEN i % 2 = 1 THEN 1.0 ELSE -1.0 END), 2))) AS dist FROM embeddings WHERE label >= 2)
ORDER BY dist, vec_id LIMIT 10""",
    "image_sizes": "SELECT n_nationkey, made, CAST(n_nationkey + 3 AS BIGINT) AS width, CAST(n_nationkey * 2 + 5 AS BIGINT) AS height FROM nation, (VALUES ('png'), ('gif'), ('bmp'), ('bmp_core')) m(made)",
    "image_limits": """SELECT p_partkey, CASE WHEN p_size > 40 THEN 'declared_size' WHEN p_partkey % 3 = 1 THEN 'mime' WHEN p_size < 10 THEN 'min_side' WHEN p_size * p_size < 200 THEN 'min_pixels' ELSE '' END AS reason FROM part""",
    "objects_verified": "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'sha256_mismatch' ELSE 'ok' END AS status FROM part",
    "answers_checked": "SELECT p_partkey, CAST((p_size >= 50)::INTEGER + (length(p_brand) > 6)::INTEGER + (p_partkey % 4 = 0)::INTEGER AS BIGINT) AS faults FROM part",
    "page_bodies_by_markup": "SELECT n_nationkey, n_name || '|Body é of ' || n_name || '|one|two' AS texts FROM nation",
    "page_encodings": "SELECT kind, 'żółw' AS text FROM (VALUES ('mark'), ('header'), ('declared'), ('default'), ('comment'), ('plain')) t(kind)",
    "sections": """WITH b AS (SELECT DISTINCT document_id, block_id, position, kind, heading_level FROM blocks),
h AS (SELECT document_id, min(position) AS a FROM b WHERE kind = 'heading' AND heading_level = 1 GROUP BY document_id),
e AS (SELECT h.document_id, h.a, min(b.position) AS z FROM h LEFT JOIN b ON b.document_id = h.document_id AND b.kind = 'heading' AND b.heading_level <= 1 AND b.position > h.a GROUP BY ALL)
SELECT e.document_id, count(*) AS n, min(b.position) AS first, max(b.position) AS last FROM e JOIN b ON b.document_id = e.document_id AND b.position >= e.a AND (e.z IS NULL OR b.position < e.z) GROUP BY e.document_id""",
    "hash_embeddings": "SELECT p_brand, CAST(1 AS BIGINT) AS vectors, CAST(1.0 AS DOUBLE) AS square, CAST(16 AS INTEGER) AS dim FROM part GROUP BY p_brand",
    "digests_of_rows": "SELECT count(*) AS n, count(*) AS of_both FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_linenumber FROM lineitem)",
    "vectors_checked": "SELECT vec_id, CASE vec_id % 5 WHEN 1 THEN 'null' WHEN 2 THEN 'dimension' WHEN 3 THEN 'not finite' WHEN 4 THEN 'zero' ELSE '' END AS error, vec_id % 5 = 0 AS kept FROM embeddings",
    "index_recall_bound": "SELECT 10 * count(*) AS n, true AS enough FROM embeddings WHERE vec_id % 100 = 0",
}
