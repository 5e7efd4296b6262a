"""DuckDB SQL of operators whose results SQL can express."""

from __future__ import annotations

NEAR_DUPLICATE_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, min(reach.b) AS component_id, min(reach.b) = vec_id AS kept
FROM embeddings JOIN reach ON reach.a = vec_id GROUP BY vec_id
"""

MINHASH_NEAR_DEDUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w), u AS (
  SELECT DISTINCT doc_id, x FROM (
    SELECT doc_id, x || ' ' || lead(x, 1) OVER p || ' ' || lead(x, 2) OVER p || ' ' || lead(x, 3) OVER p || ' ' || lead(x, 4) OVER p AS x FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY i)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4
  ) WHERE x IS NOT NULL
), sizes AS (SELECT doc_id, count(x) AS n FROM documents LEFT JOIN u USING (doc_id) GROUP BY doc_id), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT sizes.doc_id, n AS n_shingles, min(reach.b) AS component_id, min(reach.b) = sizes.doc_id AS kept
FROM sizes JOIN reach ON reach.a = sizes.doc_id GROUP BY sizes.doc_id, n
"""
