"""DuckDB SQL for the queries of catalog.py, over views named as the tables."""

from __future__ import annotations

TOKENS = r"list_distinct(list_transform(regexp_extract_all({0}, '[A-Za-z0-9\-\+]+'), lambda x: lower(x)))"


def tokens(c: str) -> str:
    return TOKENS.format(c)


SQUEEZED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
LABELLED = r"""
l AS (SELECT doc_id, quality AS y, toxic, CAST(length(text) AS DOUBLE) AS n_chars, CAST(len(string_split(text, chr(10))) AS DOUBLE) AS n_lines,
             round(length(text) / (length(text) + 2000.0), 4) AS p
      FROM labels JOIN documents USING (doc_id))
"""
DERIVED = """
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1
"""


def lexical(where: str, k: int) -> str:
    return f"""
WITH i AS (SELECT doc_id, len({tokens('text')}) AS n, unnest({tokens('text')}) AS token FROM documents),
q AS (SELECT item_id AS query, len({tokens('text')}) AS n_q, unnest({tokens('text')}) AS token FROM benchmark {where}),
o AS (SELECT query, doc_id, count(*) AS overlap, count(*) / (any_value(n_q) + any_value(n) - count(*)) AS score FROM q JOIN i USING (token) GROUP BY query, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM o QUALIFY rank <= {k})
"""


def profile_num(table: str, c: str) -> str:
    return f"""SELECT '{c}' AS "column", count(*) AS n, CAST(count(*) - count({c}) AS BIGINT) AS n_missing, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, round(avg({c}), 4) AS mean,
  round(CASE WHEN count({c}) = 1 THEN 0.0 ELSE stddev_samp({c}) END, 4) AS sd, CAST(count(DISTINCT {c}) + max(CAST({c} IS NULL AS INT)) AS BIGINT) AS n_unique FROM {table}"""


def profile_str(table: str, c: str) -> str:
    missing = r"^(?:n/?a|nan|null|none|missing|not\s*(?:available|applicable|reported|specified)|unknown|-|\.|--)$"
    return f"""SELECT '{c}' AS "column", count(*) AS n, CAST(count(*) FILTER ({c} IS NULL OR {c} = '') AS BIGINT) AS n_missing,
  CAST(count(*) FILTER ({c} IS NULL OR trim({c}) = '' OR regexp_matches(trim({c}), '{missing}', 'i')) AS BIGINT) AS n_pseudo, CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique,
  CAST(min(length({c})) AS BIGINT) AS shortest, CAST(max(length({c})) AS BIGINT) AS longest, round(avg(length({c})), 4) AS mean_length FROM {table}"""


def top_of(c: str) -> str:
    return f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank FROM orders WHERE {c} IS NOT NULL GROUP BY {c} QUALIFY rank <= 3"""


def stats_of(c: str, kind: str, source: str = "part") -> str:
    var = f"round(CASE WHEN count({c}) <= 1 THEN 0.0 ELSE var_samp(CAST({c} AS DOUBLE)) END, 6)" if kind == "continuous" else "CAST(NULL AS DOUBLE)"
    return f"""SELECT '{c}' AS "column", {var} AS variance, round(count(*) FILTER ({c} IS NULL OR CAST({c} AS VARCHAR) = '') / count(*), 4) AS missing_ratio, CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique, count(DISTINCT {c}) <= 1 AS constant, '{kind}' AS kind FROM {source}"""


def anova(c: str) -> str:
    return f"""SELECT '{c}' AS "column", ((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1)) / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*))) AS f
  FROM (SELECT y, count(*) AS n, sum({c}) AS s, sum({c} * {c}) AS q FROM l GROUP BY y)"""


def chi(c: str) -> str:
    return f"""SELECT '{c}' AS "column", round(sum((o - e) * (o - e) / e), 4) AS chi2 FROM (
  SELECT o, sum(o) OVER () * n / sum(n) OVER () AS e FROM (SELECT y, count(*) AS n, sum({c}) AS o FROM l GROUP BY y))"""


def info(c: str) -> str:
    return f"""SELECT '{c}' AS "column", round(sum(n / t * ln(n * t / (nx * ny))), 6) AS mi FROM (
  SELECT CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER () AS DOUBLE) AS t, CAST(sum(n) OVER (PARTITION BY x) AS DOUBLE) AS nx, CAST(sum(n) OVER (PARTITION BY y) AS DOUBLE) AS ny
  FROM (SELECT CAST({c} AS VARCHAR) AS x, quality AS y, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL))"""


DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
VECTORS = f"""
u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / n) AS v FROM (
  SELECT vec_id, label, embedding, CASE WHEN d > 0 THEN sqrt(d) ELSE 1 END AS n FROM (SELECT vec_id, label, embedding, {DOT.format('embedding', 'embedding')} AS d FROM embeddings))),
s AS (SELECT q.vec_id AS query, x.vec_id AS id, x.label, round({DOT.format('q.v', 'x.v')}, 6) AS score FROM u q JOIN u x ON q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id)
"""
EDGES = """
e0 AS (SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation),
e AS (SELECT src, dst FROM e0 UNION SELECT dst, src FROM e0)
"""
HASHES = """
t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9\\-\\+]+'))) AS token FROM documents),
c AS (SELECT doc_id, token, count(*) AS n FROM t GROUP BY ALL),
h AS (SELECT doc_id, n, CAST(('0x' || substr(md5(token), 1, 16)) AS UBIGINT) AS h FROM c),
b AS (SELECT doc_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN n ELSE -n END) >= 0 AS one FROM h, (SELECT CAST(range AS UBIGINT) AS i FROM range(64)) GROUP BY doc_id, i),
g AS (SELECT doc_id, CAST(sum(CASE WHEN one THEN (CAST(1 AS HUGEINT) << CAST(i AS INT)) ELSE 0 END) AS UBIGINT) AS sig FROM b GROUP BY doc_id)
""".replace("\\\\", "\\")

#: Signatures that share a band with a queried one, nearest first.
NEAREST = """
m AS (SELECT q.doc_id AS query, d.doc_id AS id, CAST(bit_count(xor(q.sig, d.sig)) AS BIGINT) AS distance FROM g q JOIN g d ON q.doc_id % 50 = 0 AND q.doc_id <> d.doc_id
      AND (q.sig >> 48 = d.sig >> 48 OR (q.sig >> 32) & 65535 = (d.sig >> 32) & 65535 OR (q.sig >> 16) & 65535 = (d.sig >> 16) & 65535 OR q.sig & 65535 = d.sig & 65535)),
f AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM m)
"""
SQL: dict[str, str] = {
    "lexical_topk": lexical("WHERE item_id = 0", 10) + rf"""SELECT doc_id, rank, overlap, round(score, 6) AS score,
  CASE WHEN length({SQUEEZED}) <= 120 THEN {SQUEEZED} ELSE rtrim(substr({SQUEEZED}, 1, 117)) || '...' END AS snippet FROM r JOIN documents USING (doc_id)""",
    "lexical_topk_all": lexical("", 3) + "SELECT query, doc_id, rank, round(score, 6) AS score FROM r",
    "token_index_build": f"SELECT source, token, count(*) AS n_docs FROM (SELECT source, unnest({tokens('text')}) AS token FROM documents) GROUP BY ALL",
    "token_counts": f"SELECT doc_id, CAST(len({tokens('text')}) AS BIGINT) AS n_tokens, CAST(len(regexp_extract_all(text, '[A-Za-z0-9\\-\\+]+')) AS BIGINT) AS n_words FROM documents",
    "structured_tiered_topk": f"""
WITH f AS (SELECT p_partkey AS id, CAST(p_size AS VARCHAR) AS phase, {tokens('p_name')} AS c, {tokens('p_type')} AS d, {tokens('p_brand')} AS b FROM part),
s AS (
  SELECT q.id AS query, x.id, q.phase = x.phase AS ph, len(list_intersect(q.c, x.c)) / (len(q.c) + len(x.c) - len(list_intersect(q.c, x.c))) AS c,
    len(list_intersect(q.d, x.d)) / (len(q.d) + len(x.d) - len(list_intersect(q.d, x.d))) AS d, len(list_intersect(q.b, x.b)) / (len(q.b) + len(x.b) - len(list_intersect(q.b, x.b))) AS b
  FROM f q JOIN f x ON q.id % 50 = 0 AND q.id <> x.id),
t AS (
  SELECT query, id, CASE WHEN c > 0 AND d > 0 AND b > 0 AND ph THEN 1 WHEN c > 0 AND d > 0 AND ph THEN 2 WHEN c > 0 AND ph THEN 3 WHEN c > 0 THEN 4 END AS tier,
    0.45 * c + 0.25 * d + 0.2 * b + CASE WHEN ph THEN 0.1 ELSE 0 END AS score FROM s WHERE c > 0)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY tier, round(score, 12) DESC, id) AS rank, CAST(tier AS BIGINT) AS tier, id, round(score, 6) AS score FROM t QUALIFY rank <= 5""",
    "simhash_signatures": f"WITH {HASHES} SELECT doc_id, CAST(sig >> 48 AS BIGINT) AS band0, CAST((sig >> 32) & 65535 AS BIGINT) AS band1, CAST((sig >> 16) & 65535 AS BIGINT) AS band2, CAST(sig & 65535 AS BIGINT) AS band3 FROM g",
    "simhash_lsh_pairs": f"""
WITH {HASHES},
r AS (SELECT sig, min(doc_id) AS id FROM g GROUP BY sig),
p AS (SELECT a.id AS a, b.id AS b, bit_count(xor(a.sig, b.sig)) AS distance FROM r a JOIN r b ON a.id < b.id AND (a.sig >> 48 = b.sig >> 48 OR (a.sig >> 32) & 65535 = (b.sig >> 32) & 65535 OR (a.sig >> 16) & 65535 = (b.sig >> 16) & 65535 OR a.sig & 65535 = b.sig & 65535))
SELECT a, b, CAST(distance AS BIGINT) AS distance FROM p WHERE distance <= 8 UNION ALL SELECT r.id, g.doc_id, 0 FROM g JOIN r USING (sig) WHERE g.doc_id <> r.id""",
    "vector_topk": f"WITH {VECTORS} SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10",
    "vector_topk_grouped": f"WITH {VECTORS} SELECT query, label AS id, max(score) AS score, row_number() OVER (PARTITION BY query ORDER BY max(score) DESC, label) AS rank FROM s GROUP BY query, label QUALIFY rank <= 3",
    "edges_build": f"WITH {EDGES} SELECT src, dst FROM e",
    "khop_related": f"""
WITH RECURSIVE {EDGES},
w(query, node, hop) AS (SELECT 'customer:' || c_custkey, 'customer:' || c_custkey, 0 FROM customer WHERE c_custkey % 50 = 0 UNION SELECT query, dst, hop + 1 FROM w JOIN e ON node = src WHERE hop < 3),
m AS (SELECT query, node, min(hop) AS hop FROM w GROUP BY ALL HAVING min(hop) > 0)
SELECT query, node, CAST(hop AS BIGINT) AS hop, round(1 / hop, 4) AS score, row_number() OVER (PARTITION BY query ORDER BY hop, node) AS rank FROM m WHERE node LIKE 'supplier:%' QUALIFY rank <= 5""",
    "substring_search": rf"""
WITH s AS (SELECT doc_id AS id, CAST((length(text) - length(replace(lower(text), 'license', ''))) // 7 AS BIGINT) AS hits, {SQUEEZED} AS t, instr(lower({SQUEEZED}), 'license') AS pos FROM documents WHERE contains(lower(text), 'license')),
c AS (SELECT *, greatest(1, pos - 180) AS lo, least(length(t), pos + 6 + 180) AS hi FROM s ORDER BY hits DESC, id LIMIT 10)
SELECT id, hits, CASE WHEN lo > 1 THEN '...' ELSE '' END || trim(substr(t, lo, hi - lo + 1)) || CASE WHEN hi < length(t) THEN '...' ELSE '' END AS evidence FROM c""",
    "name_lookup": """
WITH s AS (SELECT p_partkey AS id, lower(p_name) AS name, round(0.6 + CASE WHEN starts_with(lower(p_name), 'red') THEN 0.25 ELSE 0 END + greatest(0.0, 0.2 - abs(length(p_name) - 3) / 100), 3) AS score FROM part WHERE contains(lower(p_name), 'red'))
SELECT id, name, CAST(score AS DOUBLE) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s ORDER BY score DESC, id LIMIT 5""",
    "combined_score_scan": f"""
WITH f AS (SELECT p_partkey, p_size, lower(p_type) AS ty, lower(p_brand) AS br, list_distinct(string_split(lower(p_name), ' ')) AS nm, {tokens("concat_ws(' ', p_name, p_type, p_brand)")} AS tk FROM part),
s AS (SELECT q.p_partkey AS query, x.p_partkey, len(list_intersect(q.tk, x.tk)) / len(list_distinct(list_concat(q.tk, x.tk))) + 0.15 * CAST(q.p_size = x.p_size AS INT) + 0.4 * len(list_intersect(q.nm, x.nm)) / len(list_distinct(list_concat(q.nm, x.nm)))
  + 0.2 * CAST(q.ty = x.ty AS INT) + 0.25 * CAST(q.br = x.br AS INT) AS score FROM f q JOIN f x ON q.p_partkey % 50 = 0 AND x.p_partkey <> q.p_partkey)
SELECT query, p_partkey, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, p_partkey) <= 10""",
    "study_merge": """
WITH m AS (SELECT l_orderkey, avg(l_quantity) AS q, avg(l_extendedprice) AS p, list(l_returnflag ORDER BY l_linenumber, l_returnflag)[1] AS f FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_custkey, c_mktsegment, n_name, round(q, 6) AS mean_quantity, round(p, 6) AS mean_price, f AS first_flag
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN m ON l_orderkey = o_orderkey""",
    "arm_merge": "SELECT c_mktsegment, o_orderstatus, l_returnflag, count(*) AS n_lines, round(sum(l_quantity), 4) AS quantity FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey GROUP BY ALL",
    "nested_collect": """
WITH d AS (SELECT DISTINCT o_custkey, o_orderpriority || '/' || o_orderstatus AS k FROM orders),
g AS (SELECT o_custkey, list_sort(list(k))[:20] AS ks FROM d GROUP BY 1)
SELECT c_custkey, coalesce(len(ks), 0) AS n_kinds, coalesce(array_to_string(ks, '; '), '') AS kinds FROM customer LEFT JOIN g ON o_custkey = c_custkey""",
    "left_join_moa": "SELECT p_brand, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1",
    "existence_flags": "SELECT c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000) AS has_order, c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) AS has_supplier, count(*) AS n FROM customer GROUP BY ALL",
    "primary_row_select": """
SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r, bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS a FROM lineitem)
WHERE l_returnflag = 'R' OR (NOT a AND r = 1)""",
    "keep_first_union": """
WITH u AS (SELECT doc_id, quality, 'first' AS origin, 0 AS t FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, quality, 'second', 1 FROM labels)
SELECT doc_id, quality, origin FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY t, quality) = 1""",
    "diagonal_union": "SELECT c_custkey AS key, c_nationkey AS nation, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer UNION ALL SELECT s_suppkey, s_nationkey, NULL, s_acctbal FROM supplier",
    "consistent_ids": "SELECT user_id FROM events WHERE event_type IN ('click', 'error', 'purchase', 'signup', 'view') GROUP BY 1 HAVING count(DISTINCT event_type) = 5",
    "supplement_columns": "SELECT c_mktsegment, count(*) AS n FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1",
    "id_filter": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1",
    "excluded_ids": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')",
    "label_build": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 ELSE -1 END AS label, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS target FROM orders WHERE o_orderstatus IN ('F', 'O')",
    "phase_filter": "SELECT p_partkey, 'Phase ' || p_size AS phase FROM part WHERE p_size IN (1, 2, 3)",
    "several_valued_columns": """
SELECT 'o_orderstatus' AS "column", max(a) > 1 AS several FROM (SELECT count(DISTINCT o_orderstatus) AS a FROM orders GROUP BY o_custkey)
UNION ALL SELECT 'o_orderpriority', max(a) > 1 FROM (SELECT count(DISTINCT o_orderpriority) AS a FROM orders GROUP BY o_custkey) UNION ALL SELECT 'constant', false""",
    "fill_unknown": """SELECT CASE WHEN k IS NULL OR k = '1' THEN 'Unknown' ELSE k END AS k, 'Unknown' AS missing, count(*) AS n FROM (SELECT json_extract_string(props, '$.k') AS k FROM events) GROUP BY ALL""",
    "yes_no_normalise": """
WITH s AS (SELECT [' Yes - planned', 'None', '', 'unknown', 'no', 'YES', 'maybe'][event_id % 7 + 1] AS said FROM events)
SELECT said, CASE WHEN trim(lower(said)) LIKE 'yes%' THEN 'Yes' WHEN trim(lower(said)) LIKE 'no%' THEN 'No' ELSE 'Unknown' END AS value, count(*) AS n FROM s GROUP BY ALL""",
    "normalised_text": f"SELECT doc_id, md5({SQUEEZED}) AS squeezed, CASE WHEN length({SQUEEZED}) <= 80 THEN {SQUEEZED} ELSE rtrim(substr({SQUEEZED}, 1, 77)) || '...' END AS snippet FROM documents",
    "text_keys": r"""
WITH x AS (SELECT s_suppkey, 'Arm ' || s_name || ' (old): see nct0' || s_suppkey || ', NCT7; 2010-123456-12 + Drug-B' AS said FROM supplier)
SELECT s_suppkey, regexp_replace(lower(said), '[^a-z0-9]', '', 'g') AS label, trim(regexp_replace(lower(said), '[^a-z0-9]+', ' ', 'g')) AS match, 'NCT0' || s_suppkey AS trial, '2010-123456-12' AS eudract,
  array_to_string(list_filter(list_transform(regexp_split_to_array(said, '[;,|]'), lambda p: trim(p)), lambda p: p <> ''), '/') AS parts,
  trim(regexp_replace(lower(regexp_replace(string_split(said, ',')[1], '\([^)]*\)', ' ', 'g')), '[^a-z0-9]+', ' ', 'g')) AS drug FROM x""",
    "nation_regions": """
SELECT n_nationkey, ['united states', 'mexico', 'germany', 'sweden', 'congo the democratic republic of the', 'cote d ivoire', 'korea republic of', 'south korea', 'czechia', 'israel', 'united kingdom', 'timor leste'][n_nationkey % 12 + 1] AS country,
  ['NA', '', 'WEU', '', 'AF', 'AF', '', 'AP', 'EEU', 'AP', '', 'AP'][n_nationkey % 12 + 1] AS region FROM nation""",
    "name_lookup_exact": "SELECT n_nationkey AS id, lower(n_name) AS name, CAST(1 AS DOUBLE) AS score, CAST(1 AS BIGINT) AS rank FROM nation WHERE lower(n_name) = 'nation_1'",
    "split_sections": r"""
WITH p AS (SELECT doc_id, text, instr(lower(text), 'released') AS a, instr(lower(text), 'license') AS b FROM documents),
s AS (SELECT doc_id, CASE WHEN a > 0 AND b > 0 AND a < b THEN substr(text, a, b - a) WHEN a > 0 THEN substr(text, a) WHEN b > 0 THEN '' ELSE text END AS x,
  CASE WHEN a > 0 AND b > 0 AND b < a THEN substr(text, b, a - b) WHEN b > 0 THEN substr(text, b) ELSE '' END AS y FROM p)
SELECT doc_id, md5(trim(regexp_replace(x, '\s+', ' ', 'g'))) AS first, md5(trim(regexp_replace(y, '\s+', ' ', 'g'))) AS second FROM s""",
    "json_extract": "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1",
    "html_fields": r"""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS n_p FROM pages""",
    "evidence_validate": """
WITH s AS (SELECT item_id, list_transform(range(CAST(ceil(length(text) / 240) AS BIGINT)), lambda i: trim(substr(text, CAST(i * 240 + 1 AS BIGINT), 240))) AS parts FROM benchmark WHERE length(text) > 0)
SELECT item_id, count(*) AS n_docs FROM s JOIN documents d ON contains(d.text, parts[1]) WHERE len(list_filter(parts, lambda p: NOT contains(d.text, p))) = 0 GROUP BY 1""",
    "trial_features": r"""
WITH w AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9\-\+]+')) AS BIGINT) AS n_words, CAST(CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'token') AS INT) + CAST(contains(lower(text), 'released') AS INT) AS BIGINT) AS hits FROM documents),
s AS (SELECT *, round_even(least(1.0, 0.5 * least(1.0, n_words / 800) + 0.3 * least(1.0, hits / 5) + 0.2 * (0.5 / 1.5)), 3) AS score FROM w)
SELECT doc_id, n_words, hits, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 0.65 THEN 'very_strict' WHEN score >= 0.45 THEN 'moderate' ELSE 'permissive' END AS label FROM s""",
    "recommend_rules": """
WITH f AS (SELECT p_partkey AS id, p_brand, p_size, p_size / 50 AS strictness, '' AS endpoint FROM part),
m AS (SELECT p_brand, avg(strictness) AS mean FROM f GROUP BY 1), c AS (SELECT f.*, mean FROM f JOIN m USING (p_brand)),
a AS (SELECT 'randomize' AS action FROM c WHERE p_size % 2 <> 0 UNION ALL SELECT 'add_control' FROM c WHERE p_size % 3 <> 0 UNION ALL SELECT 'loosen_criteria' FROM c WHERE strictness > mean + 0.1
  UNION ALL SELECT 'review_exclusions' FROM c WHERE strictness < mean - 0.1 UNION ALL SELECT 'define_endpoint' FROM c)
SELECT action, count(*) AS n FROM a GROUP BY 1""",
    "column_profile_num": " UNION ALL ".join([*(profile_num("lineitem", c) for c in ("l_quantity", "l_discount", "l_linenumber")), profile_num("customer", "c_acctbal")]),
    "column_profile_str": " UNION ALL ".join([*(profile_str("customer", c) for c in ("c_name", "c_mktsegment")), *(profile_str("documents", c) for c in ("lang", "source"))]),
    "top_values": f"SELECT * FROM ({top_of('o_orderstatus')}) UNION ALL SELECT * FROM ({top_of('o_orderpriority')})",
    "key_duplicates": "SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS n_duplicated FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_returnflag)",
    "coverage": """
WITH u AS (SELECT 'customer' AS "table", c_custkey AS id FROM customer UNION SELECT 'orders', o_custkey FROM orders UNION SELECT 'events', user_id FROM events)
SELECT "table", count(*) AS n_ids, round(count(*) / (SELECT count(DISTINCT id) FROM u), 6) AS share FROM u WHERE id IS NOT NULL GROUP BY 1""",
    "join_coverage": "SELECT count(*) AS n_keys, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS n_found FROM (SELECT DISTINCT c_custkey FROM customer)",
    "var_stats": " UNION ALL ".join([*(stats_of(c, "continuous", "(SELECT *, 1 AS one FROM part)") for c in ("p_size", "p_retailprice", "one")), *(stats_of(c, "categorical") for c in ("p_brand", "p_type"))]),
    "problem_vars": "WITH x AS (SELECT *, 1 AS one, CASE WHEN p_size > 40 THEN p_brand END AS sparse FROM part), s AS ("
    + " UNION ALL ".join([*(stats_of(c, "continuous", "x") for c in ("p_size", "one")), *(stats_of(c, "categorical", "x") for c in ("p_brand", "sparse"))])
    + """) SELECT "column", kind, missing_ratio, n_unique, constant FROM s WHERE missing_ratio > 0.5 OR constant OR (kind = 'continuous' AND variance < 1e-10)""",
    "iqr_outliers": """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events),
q AS (SELECT event_type, max(value) FILTER (r = round_even(0.25 * (n - 1), 0) + 1) AS q25, max(value) FILTER (r = round_even(0.75 * (n - 1), 0) + 1) AS q75 FROM r GROUP BY 1)
SELECT event_type, q25, q75, count(*) FILTER (value < q25 - 1.5 * (q75 - q25) OR value > q75 + 1.5 * (q75 - q25)) AS n_outliers FROM events JOIN q USING (event_type) GROUP BY ALL""",
    "length_quantiles": """
WITH r AS (SELECT lang, length(text) AS v, row_number() OVER (PARTITION BY lang ORDER BY length(text)) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, max(n) AS n, """ + ", ".join(f"max(v) FILTER (r = round_even({q} * (n - 1), 0) + 1) AS q{round(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99)) + " FROM r GROUP BY 1",
    "json_parse_rate": "SELECT count(*) AS n, round(avg(CAST(json_valid(props) AS INT)), 6) AS rate FROM (SELECT props FROM events WHERE props IS NOT NULL ORDER BY event_id LIMIT 100)",
    "leakage_buckets": "SELECT * FROM (VALUES ('o_orderdate', 'T0'), ('o_totalprice', 'T1'), ('o_orderstatus', 'T2'), ('o_custkey', 'unknown'), ('o_orderpriority', 'unknown')) t(variable, bucket)",
    "fill_first_seen": """
WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN NULL ELSE role END AS role FROM conversations)
SELECT conv_id, turn, coalesce(role, first_value(role IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS role FROM r""",
    "field_batches": """
WITH m AS (SELECT o_orderkey, list_filter([0, 1, 2, 3, 4, 5, 6, 7], lambda i: (o_orderkey + i) % 2 <> 0) AS f FROM orders),
b AS (SELECT o_orderkey, f, unnest(range(CAST(ceil(len(f) / 3) AS BIGINT))) AS batch FROM m)
SELECT o_orderkey, batch, array_to_string(list_transform(f[batch * 3 + 1 : batch * 3 + 3], lambda i: 'f' || i), ',') AS fields FROM b""",
    "backfill_status": """
WITH b AS (SELECT o_custkey AS k, count(*) AS n, count(*) FILTER (o_orderstatus <> 'O') AS s FROM orders GROUP BY 1),
f AS (SELECT o_custkey AS k, count(*) AS n, count(*) FILTER (o_orderpriority <> '1-URGENT') AS s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
x AS (SELECT CASE WHEN b.n IS NULL THEN 'missing_base' WHEN b.s = b.n THEN 'already_present' WHEN f.n IS NULL THEN 'missing_fresh' WHEN f.s = 0 THEN 'needs_reextract' WHEN b.s + f.s >= b.n THEN 'updated' ELSE 'still_missing' END AS status FROM b FULL JOIN f USING (k))
SELECT status, count(*) AS n FROM x GROUP BY 1""",
    "impute_median": """
WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer) SELECT c_custkey, round(coalesce(v, (SELECT median(v) FROM r)), 4) AS c_acctbal FROM r""",
    "impute_mode": """
WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS v FROM customer), m AS (SELECT v FROM r WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)
SELECT c_custkey, coalesce(v, (SELECT v FROM m)) AS c_mktsegment FROM r""",
    "standard_scale": "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal FROM customer",
    "label_encode": "SELECT c_custkey, dense_rank() OVER (ORDER BY coalesce(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END, '_missing_')) - 1 AS code FROM customer",
    "onehot": "SELECT count(*) FILTER (o_orderstatus = 'F') AS \"o_orderstatus_F\", count(*) FILTER (o_orderstatus = 'O') AS \"o_orderstatus_O\", count(*) FILTER (o_orderstatus = 'P') AS \"o_orderstatus_P\" FROM orders",
    "time_split": "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) <= greatest(1, (SELECT count(*) FROM orders) // 5) THEN 'test' ELSE 'train' END AS split FROM orders",
    "stratified_split": """
WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1), s AS (SELECT quality, 'test' AS split, CAST(round(n * 0.2) AS BIGINT) AS n FROM c UNION ALL SELECT quality, 'train', n - CAST(round(n * 0.2) AS BIGINT) FROM c)
SELECT * FROM s WHERE n > 0""",
    "anova_f": f"WITH {LABELLED}, f AS ({anova('n_chars')} UNION ALL {anova('n_lines')}) SELECT \"column\", round(f, 6) AS f FROM f",
    "chi2_score": f"WITH {LABELLED} {chi('n_chars')} UNION ALL {chi('n_lines')}",
    "mutual_info": " UNION ALL ".join(map(info, ("lang", "source", "toxic"))),
    "importance_cumulative": f"""WITH {LABELLED}, f AS ({anova('n_chars')} UNION ALL {anova('n_lines')} UNION ALL {anova('p')})
SELECT "column", row_number() OVER (ORDER BY f DESC, "column") AS rank, round(sum(f) OVER (ORDER BY f DESC, "column" ROWS UNBOUNDED PRECEDING) / sum(f) OVER (), 6) AS cumulative FROM f""",
    "confusion_metrics": f"""
WITH {LABELLED}, c AS (SELECT count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 0 AND p < 0.5) AS tn FROM l)
SELECT tp, fp, fn, tn, {DERIVED}, round(tn / (tn + fp), 6) AS specificity, round(tn / (tn + fn), 6) AS npv, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy,
  round((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c""",
    "roc_auc": f"WITH {LABELLED} SELECT round(sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) / count(*), 6) AS roc_auc FROM l a JOIN l b ON a.y = 1 AND b.y = 0",
    "avg_precision": f"""
WITH {LABELLED}, s AS (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) AS n FROM l GROUP BY p), c AS (SELECT pos, sum(pos) OVER (ORDER BY p DESC) / sum(n) OVER (ORDER BY p DESC) AS precision FROM s)
SELECT round(sum(pos * precision) / sum(pos), 6) AS average_precision FROM c""",
    "threshold_sweep": f"""
WITH {LABELLED}, t AS (SELECT range AS step, 0.01 + range * (0.98 / 49) AS cut FROM range(50)),
c AS (SELECT step, count(*) FILTER (y = 1 AND p >= cut - 2e-11) AS tp, count(*) FILTER (y = 0 AND p >= cut - 2e-11) AS fp, count(*) FILTER (y = 1 AND p < cut - 2e-11) AS fn FROM l, t GROUP BY step)
SELECT step, tp, fp, fn, {DERIVED} FROM c""",
    "windowed_events": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "demographics_pivot": """
WITH c AS (SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'AUTOMOBILE') AS a, count(*) FILTER (c_mktsegment IN ('BUILDING', 'HOUSEHOLD')) AS h, count(*) FILTER (c_mktsegment = 'MACHINERY') AS m, count(*) AS t FROM customer GROUP BY 1)
SELECT c_nationkey, nullif(a, 0) AS cars, nullif(h, 0) AS houses, nullif(m, 0) AS machines, nullif(t - a - h - m, 0) AS other, t AS total, round(1 - (a * a + h * h + m * m + (t - a - h - m) * (t - a - h - m)) / (t * t), 6) AS heterogeneity FROM c""",
    "outcome_limit": """
SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'Primary' ELSE 'Secondary' END AS kind, CASE WHEN l_returnflag = 'R' THEN count(*) ELSE least(3, count(*)) END AS n
FROM (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'R' ELSE 'x' END AS l_returnflag FROM lineitem) GROUP BY l_orderkey, l_returnflag""",
    "ordered_distinct_join": """
WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY ALL) SELECT o_custkey, string_agg(o_orderpriority, '; ' ORDER BY k) AS priorities FROM f GROUP BY 1""",
    "missing_gate": """
SELECT 'p_name' AS "column", true AS kept, (SELECT count(DISTINCT p_name) > 20 FROM part) AS wide UNION ALL SELECT 'some', (SELECT avg(CAST(p_size <= 30 AS INT)) <= 0.5 FROM part), (SELECT count(DISTINCT p_brand) > 20 FROM part WHERE p_size > 30)
UNION ALL SELECT 'most', (SELECT avg(CAST(p_size <= 10 AS INT)) <= 0.5 FROM part), (SELECT count(DISTINCT p_type) > 20 FROM part WHERE p_size > 10) UNION ALL SELECT 'blank', false, false""",
    "top_ratio_features": f"""WITH {LABELLED}, f AS ({anova('n_chars')} UNION ALL {anova('n_lines')} UNION ALL {anova('p')}) SELECT "column" FROM f ORDER BY f DESC, "column" LIMIT 2""",
    "cv_folds": "SELECT quality, range AS fold, (n - range + 4) // 5 AS n FROM (SELECT quality, count(*) AS n FROM labels GROUP BY 1), range(5)",
    "best_threshold": f"""
WITH {LABELLED}, t AS (SELECT range AS step, 0.01 + range * (0.98 / 49) AS cut FROM range(50)),
c AS (SELECT step, count(*) FILTER (y = 1 AND p >= cut - 2e-11) AS tp, count(*) FILTER (y = 0 AND p >= cut - 2e-11) AS fp, count(*) FILTER (y = 1 AND p < cut - 2e-11) AS fn FROM l, t GROUP BY step),
m AS (SELECT step, tp, fp, fn, {DERIVED} FROM c) SELECT step, tp, fp, fn, f1 FROM m ORDER BY f1 DESC, step LIMIT 1""",
    "adjacency_lists": f"WITH {EDGES} SELECT src AS node, string_agg(dst, ',' ORDER BY dst) AS neighbours FROM e GROUP BY 1",
    "upsert_rows": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier",
    "resume_anti_join": "SELECT source, count(*) AS n FROM documents WHERE source NOT IN ('src0', 'src1', 'src2') OR source IS NULL GROUP BY 1",
    "event_sessions": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM c GROUP BY 1""",
    "scalar_parsers": """
SELECT ['18', '0.5', '0.25', '', '', '0.5', '2.5'][event_id % 7 + 1] AS age, ['No', 'Yes', 'Yes', 'Yes', '', 'Yes', 'Yes'][event_id % 7 + 1] AS blinded, ['0', '2', '4', '1', '', '3', ''][event_id % 7 + 1] AS level,
  ['Both', 'Female', 'Male', 'Both', ''][event_id % 5 + 1] AS sex, count(*) AS n FROM events GROUP BY ALL""",
    "focus_lengths": r"""
WITH p AS (SELECT lang, unnest(string_split(text, chr(10))) AS p FROM documents), n AS (SELECT lang, length(trim(regexp_replace(p, '\s+', ' ', 'g'))) AS n FROM p WHERE trim(p) <> '')
SELECT lang, count(*) AS chunks, min(n) AS least, max(n) AS most, round(avg(n), 4) AS mean FROM n GROUP BY 1""",
    "nested_study_records": """
WITH o AS (SELECT o_custkey, least(20, count(DISTINCT o_orderstatus || o_orderpriority)) AS n FROM orders GROUP BY 1)
SELECT CAST(c_custkey AS VARCHAR) AS trial_id, c_mktsegment AS phase, coalesce(n, 0) AS n_outcomes, n_name AS condition FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "simhash_nearest": f"WITH {HASHES}, {NEAREST} SELECT query, id, distance, 1 / (1 + distance) AS score, rank FROM f WHERE rank <= 5",
    "simhash_search": f"""
WITH {HASHES}, {NEAREST}, w AS (SELECT doc_id, {tokens('text')} AS t FROM documents),
s AS (SELECT f.query, f.id, len(list_intersect(a.t, b.t)) AS o, round(o / (len(a.t) + len(b.t) - o), 6) AS score FROM f JOIN w a ON a.doc_id = f.query JOIN w b ON b.doc_id = f.id WHERE f.rank <= 40)
SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 5""",
    "response_errors": "SELECT o_orderpriority, count(*) AS n_rows, count(*) FILTER (o_orderkey % 7 = 2) AS n_errors FROM orders GROUP BY 1",
    "answer_actions": """
SELECT ['invalid', 'final', 'final', 'tool', 'tool', 'final', 'invalid'][o_orderkey % 7 + 1] AS kind, ['', '', '', 'x', 'lookup', '', ''][o_orderkey % 7 + 1] AS tool, count(*) AS n FROM orders GROUP BY ALL""",
    "json_spans": r"""SELECT o_orderkey, '{"k": "a}\"b", "n": [' || o_orderkey || ']}' AS span FROM orders""",
    "one_or_list": """
SELECT l_orderkey, count(*) AS n, CASE WHEN count(*) = 1 THEN min(l_returnflag) ELSE '["' || string_agg(l_returnflag, '","' ORDER BY l_linenumber, l_returnflag) || '"]' END AS l_returnflag
FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1""",
    "start_dates": "SELECT c_custkey, c_mktsegment, strftime(min(o_orderdate), '%Y-%m-%d') AS day FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL",
    "missing_order": """
WITH r AS (SELECT 'p_name' AS "column", round(avg(CAST(trim(coalesce(p_name, '')) = '' AS INT)), 6) AS rate FROM part UNION ALL SELECT 'some', round(avg(CAST(coalesce(p_size > 30 AND trim(p_type) <> '', false) AS INT) * -1 + 1), 6) FROM part UNION ALL SELECT 'blank', 1.0)
SELECT "column", rate, row_number() OVER (ORDER BY rate DESC, "column") AS rank FROM r""",
    "record_blobs": "SELECT p_partkey, lower(coalesce(p_name, '') || chr(10) || CASE WHEN p_size > 30 THEN p_type ELSE '' END || chr(10) || substr(p_brand || chr(10) || p_name, 1, 12)) AS blob FROM part",
    "record_snippets": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment ELSE 'title' END AS snippet FROM customer",
    "nested_defaults": """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_size > 30 THEN p_name ELSE '' END AS title, CAST(CASE WHEN p_partkey % 2 = 0 AND p_size > 10 THEN p_size ELSE 0 END AS BIGINT) AS phase,
  CAST(CASE WHEN p_size > 20 THEN 1 ELSE 0 END AS BIGINT) AS n_arms FROM part""",
}
