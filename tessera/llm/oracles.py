"""What three of the contract's queries return, in DuckDB's SQL."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TOKENS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPACED = r"'[^\x20\x09-\x0D]+'"


def decontamination(documents: str = "documents", window: int = 13, slop: int = 8) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, w FROM (SELECT doc_id, {TOKENS} AS w FROM {documents})),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {TOKENS} AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(len(w), {window}) AS n, array_to_string(list_slice(w, i, i + {window - 1}), ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - {window - 1}))) AS i FROM b WHERE len(w) > 0)),
g AS (
  SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT r, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
m AS (SELECT DISTINCT r, i, g.n, item_id FROM g JOIN p USING (n, s)),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS x FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
k AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r),
t AS (SELECT r, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
c AS (SELECT t, count(*) AS n FROM t GROUP BY t),
y AS (SELECT item_id, t, n, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(n, 0), t) AS rank FROM (SELECT DISTINCT item_id, unnest(w) AS t FROM b) LEFT JOIN c USING (t)),
z AS (SELECT a.item_id, a.t AS one, b.t AS two FROM y a JOIN y b ON a.item_id = b.item_id AND a.rank = 1 AND b.rank = 2 AND a.n > 0 AND b.n > 0),
v AS (SELECT a.r, count(DISTINCT item_id) AS n_near FROM z JOIN t a ON a.t = one JOIN t b ON b.t = two AND b.r = a.r AND abs(a.p - b.p) <= {slop} GROUP BY a.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN h USING (r) LEFT JOIN k USING (r) LEFT JOIN v USING (r)
"""


def near_dedup(documents: str = "documents") -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, {SPACED}) AS w FROM {documents}),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) END) AS sh FROM d),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
c(doc_id, reached) AS (SELECT doc_id, doc_id FROM s UNION SELECT c.doc_id, l.b FROM c JOIN l ON c.reached = l.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM s JOIN (SELECT doc_id, min(reached) AS component_id FROM c GROUP BY doc_id) m USING (doc_id)
"""


SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {SPACED}) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0),
g AS (SELECT doc_id, i, CASE WHEN i + 34 <= len(w) THEN md5(array_to_string(list_slice(w, i, i + 34), ' ')) END AS h, w[i] AS word FROM p),
r AS (SELECT *, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS again FROM g),
x AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS 34 PRECEDING) AS gone FROM r),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS t FROM x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

DECONTAMINATION = decontamination()
NEAR_DEDUP = near_dedup()
