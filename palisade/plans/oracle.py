"""The market projection in SQL, written independently of the Spark code.

``GRAPH`` is a WITH prelude of flat ``nodes`` and ``edges`` relations; the oracle
queries in ``plans/market_queries.py`` are plain SELECTs over it.
"""

from __future__ import annotations

from palisade.plans.market import COLUMN_NAMES

_NAMES = "[" + ", ".join(f"'{n}'" for n in COLUMN_NAMES) + "]"
_N = len(COLUMN_NAMES)

ORG = "'00000000-0000-0000-0000-000000000001'"

GRAPH = f"""
WITH RECURSIVE column_list AS (
  SELECT p_partkey, p_brand, {_NAMES}[(p_size % {_N}) + 1] AS first_name,
         {_NAMES}[((p_partkey * 5 + 1) % {_N}) + 1] AS second_name, p_type
  FROM part
),
dealt AS (
  SELECT p_partkey, p_brand, first_name AS name FROM column_list
  UNION
  SELECT p_partkey, p_brand, second_name FROM column_list
),
nodes AS (
  SELECT 'urn:tpch:geo:::region/' || r_regionkey AS urn, CAST(NULL AS VARCHAR) AS parent_urn, 'codebase' AS node_type,
         1000000000000 + r_regionkey AS ord, r_name AS repo_name, CAST(NULL AS VARCHAR) AS file_path,
         CAST(NULL AS VARCHAR) AS function_name, CAST(NULL AS VARCHAR) AS http_method, CAST(NULL AS VARCHAR) AS route_path,
         CAST(NULL AS VARCHAR) AS auth_scheme, CAST(NULL AS VARCHAR) AS class_name, CAST(NULL AS VARCHAR) AS orm_table,
         CAST(NULL AS VARCHAR) AS schema_name, CAST(NULL AS VARCHAR) AS table_name, CAST(NULL AS VARCHAR) AS column_name,
         CAST(NULL AS VARCHAR) AS package_name, CAST(NULL AS VARCHAR) AS package_version, CAST(NULL AS VARCHAR) AS cve_ids,
         CAST(NULL AS VARCHAR) AS role_name, CAST(NULL AS BOOLEAN) AS role_superuser
  FROM region
  UNION ALL BY NAME
  SELECT 'urn:tpch:geo:::nation/' || n_nationkey AS urn, 'urn:tpch:geo:::region/' || n_regionkey AS parent_urn, 'file' AS node_type,
         2000000000000 + n_nationkey AS ord, 'src/nation_' || n_nationkey || '.py' AS file_path
  FROM nation
  UNION ALL BY NAME
  SELECT 'urn:tpch:party:::customer/' || c_custkey AS urn, 'urn:tpch:geo:::nation/' || c_nationkey AS parent_urn, 'function' AS node_type,
         3000000000000 + c_custkey AS ord, c_name AS function_name, 'src/nation_' || c_nationkey || '.py' AS file_path,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'GET' END AS http_method,
         CASE WHEN c_mktsegment = 'BUILDING' THEN '/customers/' || c_custkey END AS route_path,
         CASE WHEN c_acctbal >= 0 THEN 'HTTPBearer' END AS auth_scheme
  FROM customer
  UNION ALL BY NAME
  SELECT 'urn:tpch:party:::supplier/' || s_suppkey AS urn, 'urn:tpch:geo:::nation/' || s_nationkey AS parent_urn, 'class' AS node_type,
         4000000000000 + s_suppkey AS ord, s_name AS class_name, 'src/nation_' || s_nationkey || '.py' AS file_path, p_name AS orm_table
  FROM supplier LEFT JOIN part ON p_partkey = s_suppkey
  UNION ALL BY NAME
  SELECT 'urn:tpch:catalog:::' || p_brand AS urn, 'schema' AS node_type, 5000000000000 + min(p_partkey) AS ord, p_brand AS schema_name
  FROM part GROUP BY p_brand
  UNION ALL BY NAME
  SELECT 'urn:tpch:catalog:::' || p_brand || '/' || p_partkey AS urn, 'urn:tpch:catalog:::' || p_brand AS parent_urn, 'table' AS node_type,
         6000000000000 + p_partkey AS ord, p_name AS table_name, p_brand AS schema_name
  FROM part
  UNION ALL BY NAME
  SELECT 'urn:tpch:catalog:::' || p_brand || '/' || p_partkey || '/' || name AS urn,
         'urn:tpch:catalog:::' || p_brand || '/' || p_partkey AS parent_urn, 'column' AS node_type,
         7000000000000 + p_partkey * 100 + list_position({_NAMES}, name) AS ord, name AS column_name
  FROM dealt
  UNION ALL BY NAME
  SELECT 'urn:tpch:deps:::' || lower(p_type) || '-' || p_size AS urn, 'dependency' AS node_type, 8000000000000 + min(p_partkey) AS ord,
         lower(p_type) || '-' || p_size AS package_name, '1.' || p_size AS package_version,
         CASE WHEN p_type = 'PROMO' THEN 'CVE-2024-' || p_size END AS cve_ids
  FROM part GROUP BY p_type, p_size
  UNION ALL BY NAME
  SELECT 'urn:tpch:catalog:::roles/' || user_id AS urn, 'identity' AS node_type, 9000000000000 + user_id AS ord,
         'user_' || user_id AS role_name, max(value) > 60 AS role_superuser
  FROM events GROUP BY user_id
),
code_lines AS (
  SELECT o_custkey, p_partkey, p_brand, CASE WHEN l_returnflag = 'R' THEN 'writes' ELSE 'reads' END AS way, min(o_orderkey) AS k
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
  GROUP BY ALL
),
grants AS (
  SELECT user_id, p_partkey, p_brand, way, min(privilege) AS privilege
  FROM (
    SELECT user_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k, event_type,
           CASE event_type WHEN 'purchase' THEN 'INSERT' WHEN 'signup' THEN 'ALL' ELSE 'SELECT' END AS privilege,
           unnest(CASE WHEN event_type = 'signup' THEN ['reads', 'writes'] WHEN event_type = 'purchase' THEN ['writes'] ELSE ['reads'] END) AS way
    FROM events
  ) e JOIN part ON p_partkey = k
  GROUP BY ALL
),
edges AS (
  SELECT parent_urn AS from_urn, urn AS to_urn, 'contains' AS edge_type, CAST(NULL AS VARCHAR) AS detection_method,
         CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS privilege, CAST(NULL AS VARCHAR) AS import_name
  FROM nodes WHERE parent_urn IS NOT NULL
  UNION ALL BY NAME
  SELECT DISTINCT 'urn:tpch:party:::customer/' || a.o_custkey AS from_urn, 'urn:tpch:party:::customer/' || b.o_custkey AS to_urn, 'calls' AS edge_type
  FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1
  JOIN customer ca ON ca.c_custkey = a.o_custkey JOIN customer cb ON cb.c_custkey = b.o_custkey
  WHERE ca.c_nationkey = cb.c_nationkey AND a.o_custkey <> b.o_custkey
  UNION ALL BY NAME
  SELECT 'urn:tpch:party:::customer/' || o_custkey AS from_urn, 'urn:tpch:catalog:::' || p_brand || '/' || p_partkey AS to_urn,
         way AS edge_type, 'orm_reference' AS detection_method, 0.9::DOUBLE AS confidence
  FROM code_lines
  UNION ALL BY NAME
  SELECT DISTINCT 'urn:tpch:party:::supplier/' || l_suppkey AS from_urn, 'urn:tpch:catalog:::' || p_brand || '/' || p_partkey AS to_urn,
         'models' AS edge_type, 'orm_tablename' AS detection_method, 1.0::DOUBLE AS confidence
  FROM lineitem JOIN part ON p_partkey = l_partkey
  UNION ALL BY NAME
  SELECT 'urn:tpch:catalog:::' || a.p_brand || '/' || a.p_partkey || '/' || a.first_name AS from_urn,
         'urn:tpch:catalog:::' || b.p_brand || '/' || b.p_partkey || '/' || b.first_name AS to_urn, 'references' AS edge_type
  FROM column_list a JOIN column_list b ON b.p_partkey = a.p_partkey + 1 AND a.p_type = b.p_type
  UNION ALL BY NAME
  SELECT DISTINCT 'urn:tpch:geo:::nation/' || c_nationkey AS from_urn, 'urn:tpch:deps:::' || lower(p_type) || '-' || p_size AS to_urn,
         'depends_on' AS edge_type, lower(p_type) AS import_name
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey
  UNION ALL BY NAME
  SELECT 'urn:tpch:catalog:::roles/' || user_id AS from_urn, 'urn:tpch:catalog:::' || p_brand || '/' || p_partkey AS to_urn, way AS edge_type, privilege
  FROM grants
),
endpoints AS (SELECT from_urn AS urn FROM edges UNION SELECT to_urn FROM edges),
vertices AS (SELECT urn FROM nodes UNION SELECT urn FROM endpoints),
tag_words(tag, rank, pattern) AS (
  VALUES ('pii.email', 1, '(^|_)e?_?mail(_address)?($|_)'), ('pii.phone', 2, '(^|_)(phone|mobile|cell|telephone)($|_)'),
         ('pii.ssn', 3, '(^|_)(ssn|social_security|tax_id)($|_)'), ('pii.name', 4, '(^|_)(first_name|last_name|full_name|surname)($|_)'),
         ('pii.address', 5, '(^|_)(address|street|city|zip_code|postal)($|_)'),
         ('secret.password', 6, '(^|_)(password|passwd|pwd|pass_hash)($|_)'),
         ('secret.token', 7, '(^|_)(token|api_key|secret_key|access_key|refresh_token)($|_)'),
         ('financial.amount', 8, '(^|_)(balance|amount|price|salary)($|_)'),
         ('financial.account', 9, '(^|_)(account_number|routing_number|iban|card_number)($|_)')
),
column_tags AS (
  SELECT column_name, string_agg(tag, ',' ORDER BY rank) AS tags
  FROM (SELECT DISTINCT column_name FROM nodes WHERE column_name IS NOT NULL) JOIN tag_words ON regexp_matches(column_name, pattern, 'i')
  GROUP BY column_name
),
table_tags AS (
  SELECT parent_urn AS urn, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags
  FROM nodes JOIN tag_words ON regexp_matches(column_name, pattern, 'i') GROUP BY parent_urn
),
sensitivity AS (
  SELECT urn, tags FROM nodes JOIN column_tags USING (column_name)
  UNION ALL SELECT urn, tags FROM table_tags
),
labels_of AS (
  SELECT urn, coalesce(function_name, class_name, column_name, table_name, schema_name, repo_name,
                       split_part(file_path, '/', -1), split_part(urn, '/', -1)) AS label FROM nodes
)
"""
