"""SQL twins of the queries in ``reference_queries``, over the same tables."""

_TOK = r"list_distinct(list_concat(regexp_extract_all(lower({t}), '[a-z0-9_]{{2,}}'), regexp_extract_all(lower({t}), '[一-鿿]+'), flatten(list_transform(regexp_extract_all(lower({t}), '[一-鿿]+'), lambda r: list_transform(range(1, length(r)), lambda i: substring(r, i, 2))))))"
_BLOCKS = "b AS (SELECT DISTINCT d.doc_id, b.position, b.kind, b.headings, b.text FROM blocks b JOIN documents d ON d.id = b.document_id)"
_DOT = "list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_L2 = "list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))"
_NORM = "sqrt(list_sum(list_transform({e}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


def _knn(distance: str) -> str:
    return f"""
SELECT query_id, match_id, rank, round(dist, 4) AS distance FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS match_id, {distance} AS dist,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY {distance}, v.vec_id) AS rank
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 5"""


SQL: dict[str, str] = {
    "scan_project": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
    "filter_pred": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "filter_python": "SELECT p_partkey, p_name, p_size FROM part WHERE p_size % 7 = 3 AND length(p_name) > 10",
    "rename_drop_add": "SELECT c_custkey AS id, c_nationkey, c_acctbal AS balance, c_mktsegment, c_acctbal < 0 AS owes FROM customer",
    "add_column_batch": "SELECT p_partkey, p_retailprice, round_even(p_retailprice * 100, 0) AS cents FROM part",
    "limit_rows": "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS \"all\" FROM orders ORDER BY o_orderkey LIMIT 1000",
    "sort_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "json_key_order": "SELECT n_nationkey, n_name FROM nation ORDER BY '{\"k\":' || CAST(n_nationkey AS VARCHAR) || '}' LIMIT 12",
    "join_inner": "SELECT o_orderkey, o_custkey, o_totalprice, c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_left": "SELECT c.c_custkey, c_name, coalesce(o_orderkey, 0) AS o_orderkey, o_orderkey IS NOT NULL AS matched FROM customer c LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 200000) o ON c.c_custkey = o.o_custkey",
    "join_semi": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "join_anti": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)",
    "join_composite": "SELECT l.l_partkey, l.l_suppkey, l_quantity, uses FROM lineitem l JOIN (SELECT l_partkey, l_suppkey, count(*) AS uses FROM lineitem GROUP BY ALL HAVING count(*) > 1) b ON l.l_partkey = b.l_partkey AND l.l_suppkey = b.l_suppkey",
    "join_right_on_suffix": "SELECT c_custkey, c_nationkey AS nation, c_name AS name, n_nationkey, n_name AS name_right FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "join_key_families": "SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS r_name FROM nation",
    "exclude_keys": "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "union_all": "SELECT c_custkey AS key, c_acctbal AS balance, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier",
    "prepend_rows": "SELECT r_regionkey AS key, r_name AS name, CAST(0 AS INTEGER) AS ahead FROM region UNION ALL SELECT n_nationkey, n_name, CAST(1 AS INTEGER) FROM nation",
    "join_chain_reduce": "SELECT n_name, o_orderstatus, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
    "bench_join_reduce": "SELECT p_brand, count(*) AS n, sum(l_quantity) AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
    "agg_global": "SELECT count(*) AS n, sum(l_quantity) AS total, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_discount), 6) AS std, max(abs(l_discount)) AS most FROM lineitem",
    "agg_null_policy": "SELECT count(*) AS rows, count(v) AS \"values\", sum(v) AS total, CAST(NULL AS DOUBLE) AS poisoned FROM (SELECT CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE CAST(event_id AS DOUBLE) END AS v FROM events)",
    "agg_std_ddof": "SELECT c_mktsegment, round(sqrt(var_pop(c_acctbal)), 5) AS std0, round(sqrt(var_pop(c_acctbal) * count(*) / (count(*) - 1)), 5) AS std1, round(sqrt(var_pop(c_acctbal) * count(*) / (count(*) - 2)), 5) AS std2 FROM customer GROUP BY c_mktsegment",
    "agg_abs_max": "SELECT s_nationkey, max(abs(s_acctbal)) AS most FROM supplier GROUP BY s_nationkey",
    "agg_own": "SELECT count(DISTINCT event_type) AS n_types, max(length(props)) AS longest FROM events",
    "reduce_count_sum": "SELECT user_id, count(*) AS n, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id",
    "reduce_ordered_fold": "SELECT user_id, round(list_reduce(list_prepend(0.0::DOUBLE, list(CAST(event_id AS DOUBLE) ORDER BY event_id)), lambda s, x: s / 2 + x), 3) AS state FROM events GROUP BY user_id",
    "reduce_python_fold": "SELECT user_id, round(list_reduce(list_prepend(0.0::DOUBLE, list(CAST(event_id AS DOUBLE) ORDER BY event_id)), lambda s, x: s / 2 + x), 3) AS state FROM events GROUP BY user_id",
    "reduce_python_combine": "SELECT event_type, count(*) AS n, bit_xor(event_id) AS x FROM events GROUP BY event_type",
    "group_batches": "SELECT event_type, CAST((rn - 1) // 32 AS BIGINT) AS group_index, (rn - 1) // 32 = (max(total) - 1) // 32 AS group_last, CAST(count(*) AS INTEGER) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS total FROM events) GROUP BY event_type, (rn - 1) // 32",
    "ordered_rank": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, count(*) OVER (PARTITION BY o_custkey) AS orders FROM orders",
    "map_row": "SELECT CAST(n_nationkey * 10 AS BIGINT) AS key, lower(n_name) AS name FROM nation",
    "map_bound_output": "SELECT s_suppkey, s_name, reverse(s_name) AS reversed FROM supplier",
    "map_bound_outputs": "SELECT p_partkey, p_size, CAST(p_size // 2 AS BIGINT) AS half, p_size % 2 = 1 AS odd FROM part",
    "map_catch": "SELECT p_partkey, CAST(100 // (p_size % 5) AS BIGINT) AS share FROM part WHERE p_size % 5 <> 0",
    "flat_map_tokens": "SELECT p_partkey, unnest(regexp_split_to_array(trim(p_type), '\\s+')) AS word FROM part",
    "map_batches_pandas": "SELECT o_orderkey, round_even(o_totalprice / 1000, 3) AS o_totalprice FROM orders",
    "map_batches_arrow": "SELECT c_custkey, lower(c_mktsegment) AS c_mktsegment FROM customer",
    "map_async_rows": "SELECT CAST(n_nationkey AS BIGINT) AS key FROM nation, generate_series(1, n_nationkey % 3) WHERE n_nationkey % 4 <> 0",
    "knn_l2": _knn(_L2),
    "knn_cosine": _knn(f"(1 - {_DOT} / ({_NORM.format(e='q.embedding')} * {_NORM.format(e='v.embedding')}))"),
    "knn_dot": _knn(f"(1 - {_DOT})"),
    "knn_per_row_filter": f"SELECT query_id, match_id, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS match_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_L2}, v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id AND q.label = v.label WHERE q.vec_id % 100 = 0 AND v.vec_id >= 10) WHERE rank <= 3",
    "knn_one": f"SELECT vec_id, round(dist, 5) AS distance FROM (SELECT v.vec_id, 1 - {_DOT} / ({_NORM.format(e='q.embedding')} * {_NORM.format(e='v.embedding')}) AS dist FROM embeddings v, (SELECT list_transform(range(64), lambda i: CASE WHEN i % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS embedding) q WHERE v.label >= 0) ORDER BY dist, vec_id LIMIT 10",
    "vector_validate_normalize": "SELECT vec_id, CAST(NULL AS VARCHAR) AS error, CAST(1.0 AS DOUBLE) AS norm FROM embeddings",
    "snap_append_read": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000",
    "snap_time_travel": "SELECT o_orderstatus, count(*) AS before, CASE WHEN o_orderstatus = 'F' THEN count(*) ELSE 0 END AS after FROM orders GROUP BY o_orderstatus",
    "snap_merge_ignore": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0",
    "snap_merge_insert": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0",
    "snap_add_columns": "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' END AS note FROM orders",
    "checkpoint_replay": "SELECT r_regionkey, r_name FROM region",
    "row_digests": "SELECT count(*) AS n FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_linenumber FROM lineitem)",
    "dedup_first_arrival": "SELECT event_id, user_id, event_type, CASE WHEN event_id = min(event_id) OVER (PARTITION BY user_id, event_type) THEN 'admitted' ELSE 'duplicate' END AS status FROM events",
    "admit_single_quota": "SELECT event_id, user_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3 THEN 'admitted' ELSE 'limited' END AS status FROM events",
    "lookup_join": "SELECT s_suppkey, n_nationkey IS NOT NULL AS hit, n_name AS name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey",
    "lookup_matches_list": "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name",
    "remaining_quota": "SELECT n_nationkey AS c_nationkey, greatest(0, 70 - (SELECT count(*) FROM customer WHERE customer.c_nationkey = n_nationkey)) AS remaining FROM nation",
    "map_cached_values": "SELECT p_partkey, upper(p_brand) || '!' AS shout FROM part",
    "events_dedup_stream": "SELECT DISTINCT user_id, event_type FROM events",
    "queue_records": "SELECT row_number() OVER (ORDER BY n_nationkey) AS sequence, 'n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS task_id, n_name AS value FROM nation QUALIFY n_nationkey >= 10",
    "terms_overlap_rank": f"""WITH {_BLOCKS},
q AS (SELECT * FROM (VALUES (1, 'copper bridge near the river'), (2, 'restored chapel wheel'), (3, 'Who repaired the old mill?')) t(question_id, text)),
bt AS (SELECT doc_id, position, unnest({_TOK.format(t="(array_to_string(headings, ' ') || ' ' || text)")}) AS term FROM b),
qt AS (SELECT question_id, unnest({_TOK.format(t='text')}) AS term FROM q),
s AS (SELECT question_id, doc_id, position, count(*) AS score FROM bt JOIN qt USING (term) GROUP BY ALL HAVING count(*) >= 2)
SELECT question_id, doc_id, position, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY score DESC, position) AS rank FROM s) WHERE rank <= 3""",
    "position_ranges": """SELECT doc_id, string_agg(format('b{:06d}..b{:06d}', a, z), ' ' ORDER BY a) AS ranges FROM (
SELECT doc_id, min(position) AS a, max(position) AS z FROM (
  SELECT doc_id, position, position - row_number() OVER (PARTITION BY doc_id ORDER BY position) AS island
  FROM (SELECT DISTINCT d.doc_id, b.position FROM blocks b JOIN documents d ON d.id = b.document_id WHERE b.kind = 'list_item'))
GROUP BY doc_id, island) GROUP BY doc_id""",
    "json_props_extract": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) > 50",
    "located_records": "SELECT row_number() OVER (ORDER BY n_nationkey) AS row, CASE WHEN n_nationkey % 6 <> 0 THEN CAST(n_nationkey AS BIGINT) ELSE -1 END AS id, n_nationkey % 6 = 0 AS bad FROM nation",
    "html_blocks": "SELECT kind, n * (SELECT count(*) FROM nation) AS n, coalesce(last_text, (SELECT max(n_name) FROM nation)) AS last_text FROM (VALUES ('heading', CAST(1 AS BIGINT), NULL), ('paragraph', 1, 'one two'), ('list_item', 2, 'b'), ('table', 1, '1 | 2')) t(kind, n, last_text)",
    "url_normalize": r"""SELECT DISTINCT url, CASE WHEN lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) IN ('http', 'https') THEN
  lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) || CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END || regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) END AS normal FROM urls""",
    "url_policy": r"""SELECT CASE WHEN host = 'kelmora.example' OR host LIKE '%.kelmora.example' THEN 'blocked_domain:kelmora.example' WHEN regexp_matches(path, '^/view') THEN '' WHEN regexp_matches(path, '^/\d{4}/') THEN 'url_rule:dated' ELSE '' END AS reason, count(*) AS n
FROM (SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM urls) GROUP BY 1""",
    "prompt_render": "SELECT n_nationkey, 'Nation ' || n_name || ' has key ' || CAST(n_nationkey AS VARCHAR) || '.' AS prompt FROM nation",
    "prompt_journal_reuse": "SELECT o_orderpriority, 2 * count(*) AS n, CAST(1 AS BIGINT) AS answers, CAST(0 AS BIGINT) AS errors FROM orders GROUP BY o_orderpriority",
    "embed_hash_projection": "SELECT p_partkey, CAST(16 AS INTEGER) AS dim, CAST(NULL AS VARCHAR) AS error FROM part",
    "spans": r"SELECT doc_id, CAST(greatest(0, w - 20 - 1) // 180 + 1 AS BIGINT) AS n FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w FROM documents) WHERE w > 0",
    "read_own_source": "SELECT CAST(i AS BIGINT) AS task, CAST(j AS BIGINT) AS n FROM generate_series(0, 5) a(i), generate_series(0, 5) b(j) WHERE j < i",
    "write_own_sink": "SELECT count(*) AS reported, count(*) AS n FROM customer",
    "csv_round_trip": "SELECT CAST(n_nationkey AS VARCHAR) AS k, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'a \"q\", ' || n_name || chr(10) || 'b' END AS v FROM nation",
    "json_round_trip": "SELECT r_regionkey, r_name FROM region",
    "sample_rows": "SELECT true AS near",
    "shuffle_rows": "SELECT count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS keys FROM supplier",
    "bench_cpu_map": "SELECT k, count(*) AS n, CAST(sum(x) AS BIGINT) AS total FROM (SELECT l_orderkey % 1000 AS k, list_reduce(list_prepend(l_orderkey, range(200)), lambda s, i: (s * 1103515245 + 12345) & 2147483647) AS x FROM lineitem) GROUP BY k",
    "components": """WITH RECURSIVE l AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 50),
e AS (SELECT DISTINCT a.l_suppkey AS a, b.l_suppkey AS b FROM l a JOIN l b USING (l_partkey) WHERE a.l_suppkey <> b.l_suppkey),
r(node, seen) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT node, min(seen) AS component FROM r GROUP BY node""",
}
