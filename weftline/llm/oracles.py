"""SQL twins of the queries that SQL can express on whole tables."""

_P1 = r"""
site AS (
  SELECT document_id, min(s) AS site FROM (
    SELECT document_id, regexp_extract(lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '([^.]+\.)?[^.]+$') AS s
    FROM urls) WHERE document_id IS NOT NULL AND s <> '' GROUP BY document_id),
b AS (SELECT DISTINCT d.doc_id, b.document_id, b.position, b.text FROM blocks b JOIN documents d ON d.id = b.document_id WHERE b.text IS NOT NULL),
l AS (
  SELECT doc_id, document_id, position, CAST(i - 1 AS INTEGER) AS line_no, line, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') AS norm
  FROM (SELECT doc_id, document_id, position, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM b)),
n AS (SELECT l.*, s.site FROM l JOIN site s USING (document_id) WHERE length(norm) >= 4),
doc AS (
  SELECT n.doc_id, n.site, string_agg(DISTINCT norm, chr(10) ORDER BY norm) AS lines, any_value(floor(d.observed / 86400)) AS day
  FROM n JOIN documents d USING (doc_id) GROUP BY n.doc_id, n.site),
cluster AS (SELECT site, lines, min(day) AS day, row_number() OVER (ORDER BY site, lines) AS number FROM doc GROUP BY site, lines),
often AS (
  SELECT n.site, n.norm FROM n JOIN doc USING (doc_id, site) JOIN cluster c ON c.site = doc.site AND c.lines = doc.lines
  GROUP BY n.site, n.norm
  HAVING count(DISTINCT n.doc_id) >= 6 AND count(DISTINCT c.number) >= 6 AND count(DISTINCT c.day) + count(DISTINCT CASE WHEN c.day IS NULL THEN c.number END) >= 2),
found AS (SELECT DISTINCT doc_id, position, line_no FROM n JOIN often USING (site, norm))
"""

ORACLES: dict[str, str] = {
    "p1_found": f"WITH {_P1} SELECT doc_id, position, line_no FROM found",
    "p1_clean": f"""WITH {_P1},
kept AS (
  SELECT l.doc_id, l.position, string_agg(l.line, chr(10) ORDER BY l.line_no) AS text
  FROM l LEFT JOIN found f ON f.doc_id = l.doc_id AND f.position = l.position AND f.line_no = l.line_no
  WHERE f.doc_id IS NULL GROUP BY l.doc_id, l.position),
whole AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY position) AS text FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(w.text, '') AS text FROM documents d LEFT JOIN whole w USING (doc_id)""",
    "p6_invariants": """SELECT CAST(s.spec_id AS INTEGER) AS spec_id, CAST(0 AS BIGINT) AS "over", CAST(0 AS BIGINT) AS wrong_sums, n AS texts, CAST(0 AS BIGINT) AS broken
FROM pack_specs s, (SELECT count(*) AS n FROM documents WHERE text <> '')""",
    "p7_invariants": """SELECT source_id, true AS kept, true AS near FROM mix_targets WHERE source_id IN (SELECT source_id FROM documents WHERE text <> '')""",
}
