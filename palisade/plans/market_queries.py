"""Registered queries over the market graph, each with its SQL oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import ids, labels, meta, scalars, urn
from palisade.model import Graph
from palisade.operators import code_data, compliance, enrich, legality, mutate, rules, search, security, soft_links, traverse
from palisade.plans.market import MarketGraph, customer_urn, market_graph
from palisade.plans.oracle import GRAPH
from palisade.plans.tables import Tables
from palisade.session import shared_folder
from palisade.sources import graph_json
from palisade.sources.store import ParquetStore, report, with_status

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

CUSTOMER = "urn:tpch:party:::customer/81"
NATION = "urn:tpch:geo:::nation/3"


def query(name: str, sql: str | None = None, graph: bool = True):
    """Register ``fn(graph)`` (or ``fn(tables)``) under a name with its oracle."""

    def wrap(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(market_graph(spark, folder) if graph else Tables(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = (GRAPH if graph else "") + sql
        return fn

    return wrap


class EnrichedMarket(MarketGraph):
    """The market graph with tags: columns tag themselves, tables inherit."""

    def of_type(self, *types: str) -> DataFrame:
        if set(types) & {"table", "column"}:
            return enrich.enrich_sensitivity(super().of_type(*{*types, "column"})).filter(F.col("node_type").isin(*types))
        return super().of_type(*types)

    @property
    def nodes(self) -> DataFrame:  # type: ignore[override]
        return enrich.enrich_sensitivity(super().nodes)


def enriched_market(spark: SparkSession, folder: str) -> EnrichedMarket:
    return EnrichedMarket(Tables(spark, folder))


def enriched_query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = lambda spark, folder: fn(enriched_market(spark, folder))
        if sql is not None:
            ORACLES[name] = GRAPH + sql
        return fn

    return wrap


# --- search and labels ---------------------------------------------------------


@query("q1_search_name", """
, hits AS (SELECT n.urn, node_type, label, ord FROM nodes n JOIN labels_of l ON l.urn = n.urn
  WHERE lower(concat_ws('|', table_name, column_name, schema_name, class_name, function_name, file_path, repo_name)) LIKE '%blue%')
SELECT urn, node_type, label, (SELECT count(*) FROM hits) AS total, greatest((SELECT count(*) FROM hits) - 10 - 50, 0) AS remaining
FROM hits ORDER BY ord, urn LIMIT 50 OFFSET 10""")
def _(g):
    return search.search_nodes(g, limit=50, offset=10, name_pattern="BLUE")


@query("q1_search_metadata", """
SELECT urn, node_type, cve_ids FROM nodes WHERE node_type = 'dependency' AND cve_ids LIKE '%2024-1%'""")
def _(g):
    hits = search.matching_nodes(g, node_type="dependency", metadata_key="cve_ids", metadata_value="2024-1")
    return hits.select("urn", "node_type", meta.get(hits, "cve_ids").alias("cve_ids"))


@query("q1_search_urn", "SELECT v.urn, coalesce(node_type, 'unknown') AS node_type FROM vertices v LEFT JOIN nodes n ON n.urn = v.urn WHERE lower(v.urn) LIKE '%brand#1%'")
def _(g):
    return search.matching_nodes(g, urn_pattern="BRAND#1").select("urn", "node_type")


_NEIGHBOURS = f"""
, around AS (
  SELECT 'out' AS way, edge_type, to_urn AS urn FROM edges WHERE from_urn = '{NATION}'
  UNION ALL SELECT 'in', edge_type, from_urn FROM edges WHERE to_urn = '{NATION}')
, named AS (SELECT way, edge_type, a.urn, coalesce(node_type, 'unknown') AS node_type, coalesce(label, split_part(a.urn, '/', -1)) AS label
  FROM around a LEFT JOIN nodes n ON n.urn = a.urn LEFT JOIN labels_of l ON l.urn = a.urn)
"""


@query("q2_node_details", _NEIGHBOURS + f"""
SELECT 'metadata' AS part, 'file_path' AS key, file_path AS value FROM nodes WHERE urn = '{NATION}'
UNION ALL SELECT 'metadata', 'language', 'python' FROM nodes WHERE urn = '{NATION}'
UNION ALL SELECT way || '_edge', edge_type, '[' || node_type || '] ' || label FROM named""")
def _(g):
    return search.get_node_details(g, NATION)


@query("q3_neighbors", _NEIGHBOURS + "SELECT * FROM named")
def _(g):
    return search.get_neighbors(g, NATION)


@query("q4_metadata_filter", "SELECT urn FROM nodes WHERE node_type = 'function' AND http_method = 'GET' AND auth_scheme IS NOT NULL")
def _(g):
    nodes = g.of_type("function")
    return nodes.filter(search.metadata_filter(nodes, {"http_method": "GET", "auth_scheme": True}, "AND")).select("urn")


@query("q5_query_labels", "SELECT urn, label FROM labels_of")
def _(g):
    return search.labelled(g.nodes).select("urn", "label")


@query("q6_q7_security_labels", """
SELECT urn, coalesce(nullif(function_name, ''), nullif(class_name, ''), nullif(table_name, ''), nullif(column_name, ''), nullif(role_name, ''), urn) AS label,
       coalesce(nullif(function_name, ''), class_name, '?') || ' in ' || coalesce(file_path, '?') AS code_label FROM nodes""")
def _(g):
    n = g.nodes
    return n.select("urn", labels.security_label(n).alias("label"), labels.code_label(n).alias("code_label"))


@query("q8_classify", """
SELECT urn, CASE WHEN function_name IS NOT NULL THEN 'function' WHEN class_name IS NOT NULL THEN 'class'
  WHEN column_name IS NOT NULL THEN 'column' WHEN table_name IS NOT NULL THEN 'table' WHEN schema_name IS NOT NULL THEN 'schema'
  WHEN repo_name IS NOT NULL THEN 'codebase' WHEN file_path IS NOT NULL THEN 'file' WHEN package_name IS NOT NULL THEN 'dependency'
  WHEN role_name IS NOT NULL THEN 'db_role' ELSE 'unknown' END AS node_type FROM nodes""")
def _(g):
    return labels.settle_types(g.nodes.withColumn("node_type", F.lit("unknown"))).select("urn", "node_type")


@query("q9_event_edge_namespace", """
SELECT 'evt:' || event_type || ':' || user_id AS edge_type, 'evt' AS namespace, count(*) AS n FROM events GROUP BY ALL
UNION ALL SELECT event_type, NULL, count(*) FROM events GROUP BY ALL""", graph=False)
def _(t):
    types = t.events.select(
        F.explode(F.array(F.concat_ws(":", F.lit("evt"), "event_type", F.col("user_id").cast("string")), "event_type")).alias("edge_type")
    )
    return types.groupBy("edge_type").agg(F.count("*").alias("n")).select("edge_type", labels.edge_namespace(F.col("edge_type")).alias("namespace"), "n")


@query("q10_dashboard_edges", """
, kind AS MATERIALIZED (SELECT urn, node_type FROM nodes)
, link AS MATERIALIZED (SELECT from_urn, to_urn, edge_type FROM edges WHERE edge_type <> 'calls')
SELECT e.from_urn, e.to_urn, e.edge_type FROM link e JOIN kind f ON f.urn = e.from_urn JOIN kind t ON t.urn = e.to_urn
WHERE f.node_type NOT IN ('schema', 'identity') AND t.node_type NOT IN ('schema', 'identity') AND e.edge_type <> 'calls'
  AND NOT (e.edge_type = 'contains' AND f.node_type IN ('database', 'schema', 'codebase', 'file'))""")
def _(g):
    return search.dashboard_edges(g, ["schema", "identity"], ["calls"]).select("from_urn", "to_urn", "edge_type")


@query("q11_dashboard_search", "SELECT urn, node_type FROM nodes WHERE lower(urn) LIKE '%brand#2%' AND table_name IS NOT NULL ORDER BY ord, urn LIMIT 10")
def _(g):
    return search.dashboard_search(g, "brand#2", "table_name", 10)


@query("q12_metadata_keys", """
, flat AS (SELECT count(repo_name) AS repo_name, count(repo_name) AS repo_url, count(file_path) AS file_path, count(function_name) AS function_name,
  count(http_method) AS http_method, count(route_path) AS route_path, count(auth_scheme) AS auth_scheme, count(class_name) AS class_name,
  count(orm_table) AS orm_table, count(schema_name) AS schema_name, count(table_name) AS table_name, count(column_name) AS column_name,
  count(package_name) AS package_name, count(package_version) AS package_version, count(package_name) AS package_ecosystem, count(cve_ids) AS cve_ids,
  count(role_name) AS role_name, count(role_superuser) AS role_superuser, count(*) FILTER (node_type = 'file') AS language FROM nodes)
SELECT key, n FROM (UNPIVOT flat ON COLUMNS(*) INTO NAME key VALUE n) WHERE n > 0""")
def _(g):
    return search.metadata_keys(g)


@query("q13_schema_exclusion", "SELECT DISTINCT p_brand AS schema_name FROM part WHERE NOT regexp_matches(p_brand, '^brand#1.*$', 'i') AND lower(p_brand) <> 'brand#2'", graph=False)
def _(t):
    return t.part.select(F.col("p_brand").alias("schema_name")).distinct().filter(~scalars.excluded(F.col("schema_name"), ["BRAND#1*"], ("Brand#2",)))


# --- aggregates ------------------------------------------------------------------


@query("a1_graph_summary", """
SELECT 'node_type' AS kind, node_type AS name, count(*) AS n FROM nodes GROUP BY node_type
UNION ALL SELECT 'edge_type', edge_type, count(*) FROM edges GROUP BY edge_type
UNION ALL SELECT 'total', 'nodes', count(*) FROM vertices
UNION ALL SELECT 'total', 'edges', count(*) FROM edges
UNION ALL SELECT 'total', 'table_names', count(DISTINCT table_name) FROM nodes WHERE node_type = 'table' AND table_name <> ''""")
def _(g):
    return search.graph_summary(g)


@query("a1_table_names", "SELECT DISTINCT table_name FROM nodes WHERE node_type = 'table'")
def _(g):
    return search.table_names(g)


_ACCESS = """
, access AS (
  SELECT t.table_name, CASE WHEN e.detection_method = 'orm_tablename' THEN 'model' ELSE 'function' END AS kind, s.urn, e.edge_type,
         coalesce(CASE WHEN e.detection_method = 'orm_tablename' THEN s.class_name ELSE s.function_name END, '?') AS name, coalesce(s.file_path, '?') AS file_path
  FROM edges e JOIN nodes t ON t.urn = e.to_urn AND t.node_type = 'table' JOIN nodes s ON s.urn = e.from_urn
  WHERE e.edge_type IN ('reads', 'writes', 'models'))
"""


@query("a2_table_access_map", _ACCESS + "SELECT * FROM access")
def _(g):
    return code_data.table_access(g).drop("via_model")


@query("a2_table_access_counts", _ACCESS + "SELECT table_name, count(*) FILTER (kind = 'model') AS models, count(*) FILTER (kind = 'function') AS functions FROM access GROUP BY 1")
def _(g):
    return code_data.table_access_counts(g)


@query("a3_orphaned_tables", """
SELECT urn, schema_name, table_name,
       (SELECT count(*) FROM edges r WHERE r.edge_type = 'references' AND (r.from_urn = n.urn OR r.to_urn = n.urn)) AS fk_edges
FROM nodes n WHERE node_type = 'table' AND urn NOT IN (SELECT to_urn FROM edges WHERE edge_type IN ('reads', 'writes', 'models'))""")
def _(g):
    return code_data.find_orphaned_tables(g)


@query("a3_tables_without_grants", """
, own AS MATERIALIZED (SELECT from_urn, to_urn, edge_type FROM edges WHERE edge_type = 'references' OR from_urn LIKE 'urn:tpch:catalog:::roles/%')
SELECT urn, schema_name, table_name,
       (SELECT count(*) FROM own r WHERE r.edge_type = 'references' AND (r.from_urn = n.urn OR r.to_urn = n.urn)) AS fk_edges
FROM nodes n WHERE node_type = 'table' AND urn NOT IN (SELECT to_urn FROM own WHERE edge_type IN ('reads', 'writes', 'models'))""")
def _(g):
    """Of what code does nothing is left, so tables that no role may touch are orphans."""
    edges = g.edges_of("references", "reads", "writes", "models")
    own = edges.filter((F.col("edge_type") == "references") | F.col("from_urn").startswith("urn:tpch:catalog:::roles/"))
    return code_data.find_orphaned_tables(Graph(g.nodes, own))


_COMPONENTS = """
, links AS (SELECT from_urn AS a, to_urn AS b FROM edges WHERE edge_type IN ('calls', 'instantiates')
            UNION SELECT to_urn, from_urn FROM edges WHERE edge_type IN ('calls', 'instantiates'))
, component(urn, component) USING KEY (urn) AS (SELECT DISTINCT a, a FROM links UNION (
    SELECT DISTINCT ON (u.urn) u.urn, v.component FROM recurring.component u JOIN links e ON e.a = u.urn JOIN component v ON v.urn = e.b
    WHERE v.component < u.component ORDER BY u.urn, v.component))
"""


@query("a4_data_hubs", _COMPONENTS + """
, clusters AS (SELECT * FROM component UNION ALL
  SELECT DISTINCT from_urn, from_urn FROM edges WHERE edge_type IN ('reads', 'writes', 'models') AND from_urn NOT IN (SELECT urn FROM component))
, sized AS (SELECT component, count(*) AS members FROM clusters GROUP BY 1)
, touched AS (SELECT c.component, count(DISTINCT t.table_name) AS tables FROM clusters c JOIN edges e ON e.from_urn = c.urn AND e.edge_type IN ('reads', 'writes', 'models')
  JOIN nodes t ON t.urn = e.to_urn AND t.node_type = 'table' GROUP BY 1)
SELECT component, tables, members FROM touched JOIN sized USING (component) WHERE tables >= 3 ORDER BY tables DESC, component LIMIT 10""")
def _(g):
    return code_data.find_data_hubs(g, 3, 10)


@query("a5_edge_type_histogram", "SELECT edge_type, count(*) AS n FROM edges GROUP BY 1")
def _(g):
    return search.type_counts(g.edges, "edge_type")


@query("a9_node_type_counts", "SELECT node_type, count(*) AS n FROM nodes GROUP BY 1")
def _(g):
    return search.type_counts(g.nodes, "node_type")


@enriched_query("a7_f6_sensitivity", "SELECT urn, tags FROM sensitivity")
def _(g):
    n = g.of_type("table", "column")
    return n.select("urn", meta.get(n, "data_sensitivity").alias("tags")).filter("tags <> ''")


# --- code and data ---------------------------------------------------------------

_PICK = ", pick AS (SELECT urn FROM nodes WHERE node_type = 'table' AND table_name = 'blue bolt' ORDER BY ord DESC LIMIT 1)"


@query("x6_code_for_table", _PICK + """
SELECT CASE WHEN detection_method = 'orm_tablename' THEN 'models' WHEN detection_method = 'orm_reference' THEN 'functions' ELSE 'other' END AS section,
  e.from_urn AS urn, e.edge_type, coalesce(CASE WHEN detection_method = 'orm_tablename' THEN class_name ELSE function_name END, '?') AS name,
  coalesce(file_path, '?') AS file_path, confidence
FROM edges e LEFT JOIN nodes n ON n.urn = e.from_urn WHERE e.to_urn = (SELECT urn FROM pick) AND edge_type IN ('reads', 'writes', 'models')""")
def _(g):
    return code_data.find_code_for_table(g, "blue bolt")


@query("x7_tables_for_code", """
SELECT n.urn, n.node_type, n.function_name AS label, e.edge_type, t.table_name, e.detection_method AS method
FROM nodes n LEFT JOIN edges e ON e.from_urn = n.urn AND e.edge_type IN ('reads', 'writes', 'models') LEFT JOIN nodes t ON t.urn = e.to_urn
WHERE n.function_name = 'Customer#000000081'""")
def _(g):
    return code_data.find_tables_for_code(g, "Customer#000000081")


@enriched_query("x1_sensitive_data", """
SELECT n.urn, n.node_type, coalesce(n.table_name, n.column_name) AS label, s.tags, p.table_name
FROM sensitivity s JOIN nodes n ON n.urn = s.urn LEFT JOIN nodes p ON p.urn = n.parent_urn AND n.column_name IS NOT NULL
WHERE regexp_matches(s.tags, '(^|,)pii')""")
def _(g):
    return security.find_sensitive_data(g, "pii")


@enriched_query("x2_sensitive_access", _PICK + """
SELECT 'table' AS part, urn, 'blue bolt' AS name, tags FROM pick JOIN sensitivity USING (urn)
UNION ALL SELECT 'column', n.urn, column_name, tags FROM nodes n JOIN sensitivity s ON s.urn = n.urn WHERE n.parent_urn = (SELECT urn FROM pick)
UNION ALL SELECT 'code', n.urn, coalesce(function_name, class_name, '?') || ' in ' || coalesce(file_path, '?'), NULL
  FROM edges e JOIN nodes n ON n.urn = e.from_urn WHERE e.to_urn = (SELECT urn FROM pick) AND edge_type IN ('reads', 'writes', 'models')""")
def _(g):
    return security.trace_sensitive_data_access(g, "blue bolt")


@query("x3_code_using_dependency", """
SELECT d.package_name AS package, d.package_version AS version, d.cve_ids, f.file_path, import_name FROM nodes d
LEFT JOIN edges e ON e.to_urn = d.urn AND e.edge_type = 'depends_on' LEFT JOIN nodes f ON f.urn = e.from_urn WHERE d.package_name = 'promo-12'""")
def _(g):
    return security.find_code_using_dependency(g, "PROMO-12")


@query("x4_vulnerable_code", """
SELECT d.package_name AS package, d.package_version AS version, d.cve_ids, f.file_path FROM nodes d
LEFT JOIN edges e ON e.to_urn = d.urn AND e.edge_type = 'depends_on' LEFT JOIN nodes f ON f.urn = e.from_urn WHERE d.cve_ids <> ''""")
def _(g):
    return security.find_vulnerable_code(g)


@query("x5_database_permissions", """
SELECT r.role_name, e.edge_type, e.privilege, t.table_name, r.role_superuser AS superuser, false AS grantable
FROM edges e JOIN nodes r ON r.urn = e.from_urn AND r.node_type = 'identity' JOIN nodes t ON t.urn = e.to_urn WHERE e.edge_type IN ('reads', 'writes')""")
def _(g):
    return security.find_database_permissions(g)


# --- traversal -------------------------------------------------------------------


def _reach_sql(start: str, types: str, depth: int, pairs: str) -> str:
    return f"""
, link AS (SELECT DISTINCT a, b FROM ({pairs}) WHERE a <> b)
, bfs AS (SELECT '{start}' AS urn, 0 AS depth UNION SELECT link.b, depth + 1 FROM bfs JOIN link ON link.a = bfs.urn WHERE depth < {depth})
, reached AS (SELECT urn, min(depth) AS depth FROM bfs GROUP BY urn)
"""


def _pairs(types: str | None, direction: str) -> str:
    where = f"WHERE edge_type IN ({types})" if types else "WHERE edge_type <> 'contains'" if types == "" else ""
    out = f"SELECT from_urn AS a, to_urn AS b FROM edges {where}"
    inc = f"SELECT to_urn AS a, from_urn AS b FROM edges {where}"
    return {"outgoing": out, "incoming": inc, "both": f"{out} UNION ALL {inc}"}[direction]


_BLAST = "'calls', 'reads', 'writes', 'models', 'references', 'soft_reference', 'depends_on'"
_REVERSE = "'reads', 'writes', 'models', 'calls'"
_DATA = "'references', 'soft_reference', 'reads', 'writes', 'models'"
TABLE = "urn:tpch:catalog:::Brand#17/1"
COLUMN_START = TABLE


@query("g1_reach", _reach_sql(CUSTOMER, _BLAST, 5, _pairs(_BLAST, "outgoing")) + "SELECT urn, depth FROM reached")
def _(g):
    return traverse.reach(traverse.adjacency(g, security.BLAST_EDGES, "outgoing"), CUSTOMER, 5)


@query("g2_trace_data_path", _reach_sql(COLUMN_START, _DATA, 3, _pairs(_DATA, "both"))
       + f"SELECT r.urn, depth, coalesce(node_type, 'unknown') AS node_type FROM reached r LEFT JOIN nodes n ON n.urn = r.urn WHERE r.urn <> '{COLUMN_START}'")
def _(g):
    return traverse.trace_data_path(g, COLUMN_START, max_depth=3, direction="both")


_EGO = _reach_sql(CUSTOMER, "", 2, _pairs("", "both"))


@query("g3_subgraph_edges", _EGO + "SELECT from_urn, to_urn, edge_type FROM edges WHERE from_urn IN (SELECT urn FROM reached) AND to_urn IN (SELECT urn FROM reached)")
def _(g):
    return traverse.subgraph_links(g, CUSTOMER, 2).select("from_urn", "to_urn", "edge_type")


@query("g8_focus_nodes", _EGO + "SELECT urn, depth FROM reached")
def _(g):
    return traverse.ego_nodes(g, CUSTOMER, 2)


@query("a10_subgraph_type_counts", _EGO + "SELECT coalesce(node_type, 'unknown') AS node_type, count(*) AS n FROM reached r LEFT JOIN nodes n ON n.urn = r.urn GROUP BY 1")
def _(g):
    return traverse.subgraph_type_counts(g, CUSTOMER, 2)


_PATHS = """
, link AS (SELECT from_urn AS a, to_urn AS b FROM edges WHERE from_urn <> to_urn UNION SELECT to_urn, from_urn FROM edges WHERE from_urn <> to_urn)
"""


@query("g4_shortest_path", _PATHS + """
, dist(urn, depth) USING KEY (urn) AS (SELECT 'urn:tpch:geo:::region/3', 0 UNION (SELECT DISTINCT link.b, d.depth + 1 FROM dist d JOIN link ON link.a = d.urn
    WHERE NOT EXISTS (SELECT 1 FROM recurring.dist r WHERE r.urn = link.b)))
, walk AS (SELECT urn, depth, 0 AS step FROM dist WHERE urn = 'urn:tpch:party:::customer/81'
  UNION ALL SELECT urn, depth, step FROM (SELECT n.urn, n.depth, w.step + 1 AS step, row_number() OVER (ORDER BY n.urn) AS rn
    FROM walk w JOIN link ON link.a = w.urn JOIN dist n ON n.urn = link.b AND n.depth = w.depth - 1) WHERE rn = 1)
SELECT step, urn FROM walk""")
def _(g):
    return traverse.find_shortest_path(g, CUSTOMER, "urn:tpch:geo:::region/3").select("step", "urn")


@query("g5_weak_components", _COMPONENTS + "SELECT urn, component FROM component")
def _(g):
    return traverse.weak_components(g)


@enriched_query("g6_blast_radius", _reach_sql(CUSTOMER, _BLAST, 5, _pairs(_BLAST, "outgoing")) + f"""
, bucketed AS (SELECT r.urn, depth, coalesce(node_type, 'unknown') AS node_type, CASE WHEN node_type IN ('function', 'class') THEN 'code'
  WHEN node_type IN ('table', 'column') THEN 'data' WHEN node_type = 'dependency' THEN 'dependency' ELSE 'other' END AS bucket,
  coalesce(function_name, class_name, table_name, column_name, role_name, r.urn) AS label, s.tags, cve_ids
  FROM reached r LEFT JOIN nodes n ON n.urn = r.urn LEFT JOIN sensitivity s ON s.urn = r.urn WHERE r.urn <> '{CUSTOMER}')
SELECT urn, depth, node_type, bucket, label, CASE WHEN bucket = 'data' THEN tags END AS tags, CASE WHEN bucket = 'dependency' THEN cve_ids END AS cve_ids FROM bucketed""")
def _(g):
    return security.blast_radius(g, CUSTOMER, 5)


@query("g6r_reverse_blast_radius", _reach_sql(TABLE, _REVERSE, 5, _pairs(_REVERSE, "incoming")) + f"""
SELECT r.urn, depth, coalesce(node_type, 'unknown') AS node_type, CASE WHEN node_type IN ('function', 'class') THEN 'code' WHEN node_type = 'identity' THEN 'principal' ELSE 'other' END AS bucket,
  coalesce(function_name, class_name, table_name, column_name, role_name, r.urn) AS label, coalesce(route_path <> '', false) AS endpoint,
  CASE WHEN route_path <> '' THEN http_method || ' ' || route_path END AS route, CASE WHEN route_path <> '' THEN auth_scheme END AS auth_scheme
FROM reached r LEFT JOIN nodes n ON n.urn = r.urn WHERE r.urn <> '{TABLE}'""")
def _(g):
    return security.reverse_blast_radius(g, TABLE, 5)


LINKED = rules.Rule("brand_near_region", "schema", {"schema_name": True}, dest_node_type="codebase", dest_node_metadata={"repo_name": True})


@query("g9_h6_linked_rule", _PATHS + """
, dist(dest, urn, depth) USING KEY (dest, urn) AS (SELECT urn, urn, 0 FROM nodes WHERE node_type = 'codebase' UNION (SELECT DISTINCT d.dest, link.b, d.depth + 1 FROM dist d JOIN link ON link.a = d.urn
    WHERE NOT EXISTS (SELECT 1 FROM recurring.dist r WHERE r.dest = d.dest AND r.urn = link.b)))
SELECT d.urn AS source_urn, dest AS dest_urn, depth AS hops FROM dist d JOIN nodes n ON n.urn = d.urn WHERE n.node_type = 'schema'""")
def _(g):
    return rules.find(g, LINKED).select("source_urn", "dest_urn", (F.size("path") - 1).alias("hops"))


@query("g10_f1_f28_urn_functions", """
SELECT urn, split_part(urn, ':', 2) AS provider, split_part(urn, ':', 3) AS service, regexp_extract(urn, '^urn:[^:]*:[^:]*:[^:]*:[^:]*:(.*)$', 1) AS path,
  CASE WHEN contains(regexp_extract(urn, '^urn:[^:]*:[^:]*:[^:]*:[^:]*:(.*)$', 1), '/') THEN regexp_replace(urn, '/[^/]*$', '') END AS parent,
  array_to_string(string_split(split_part(urn, ':', -1), '/')[-3:], '/') AS short_label FROM nodes""")
def _(g):
    u = F.col("urn")
    return g.nodes.select(
        "urn", urn.part(u, "provider").alias("provider"), urn.part(u, "service").alias("service"), urn.part(u, "path").alias("path"),
        urn.parent(u).alias("parent"), urn.short_label(u).alias("short_label"),
    )


@query("f3_edge_ids", """
, named AS (SELECT from_urn, to_urn, edge_type, sha1(unhex('039c74f2ed315158a5ff5ab3a6944067') || encode(from_urn || ':' || to_urn || ':' ||
  CASE edge_type WHEN 'calls' THEN 'CODE_TO_CODE' WHEN 'contains' THEN 'CONTAINS' WHEN 'depends_on' THEN 'DEPENDS_ON' ELSE edge_type END)) AS h FROM edges)
SELECT from_urn, to_urn, edge_type, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab')
  || h[18:20] || '-' || h[21:32] AS uuid FROM named""")
def _(g):
    return g.edges.select("from_urn", "to_urn", "edge_type", "uuid")


@query("l9_duplicate_nodes", """
SELECT urn, count(*) AS n FROM (SELECT 'urn:tpch:dup:::' || p_name AS urn FROM part) GROUP BY urn HAVING count(*) > 1""", graph=False)
def _(t):
    nodes = t.part.select(F.concat(F.lit("urn:tpch:dup:::"), "p_name").alias("urn"))
    return Graph(nodes, nodes).duplicate_urns()


@query("d12_illegal_edges", """
, turned AS (SELECT from_urn, to_urn, edge_type FROM edges UNION ALL SELECT to_urn, from_urn, edge_type FROM edges WHERE edge_type = 'models')
SELECT e.from_urn, e.to_urn, e.edge_type, 'outgoing' AS side, n.node_type FROM turned e JOIN nodes n ON n.urn = e.from_urn
WHERE (n.node_type, e.edge_type) NOT IN (('codebase', 'contains'), ('file', 'contains'), ('file', 'depends_on'), ('function', 'calls'), ('function', 'reads'), ('function', 'writes'),
  ('class', 'models'), ('schema', 'contains'), ('table', 'contains'), ('column', 'references'), ('identity', 'reads'), ('identity', 'writes'))
UNION ALL SELECT e.from_urn, e.to_urn, e.edge_type, 'incoming', n.node_type FROM turned e JOIN nodes n ON n.urn = e.to_urn
WHERE (n.node_type, e.edge_type) NOT IN (('file', 'contains'), ('function', 'contains'), ('function', 'calls'), ('class', 'contains'), ('table', 'contains'), ('table', 'reads'),
  ('table', 'writes'), ('table', 'models'), ('column', 'contains'), ('column', 'references'), ('dependency', 'depends_on'))""")
def _(g):
    """Edges of one type are added once more the wrong way round."""
    kept = g.edges.select("uuid", "edge_type", "from_urn", "to_urn")
    wrong = g.edges_of("models").select("uuid", "edge_type", F.col("to_urn").alias("from_urn"), F.col("from_urn").alias("to_urn"))
    return legality.violations(Graph(g.nodes, kept.unionAll(wrong))).drop("uuid")


# --- rules -----------------------------------------------------------------------


@query("h3_insecure_endpoint", "SELECT urn AS source_urn, 'insecure_endpoint' AS heuristic_name, 'pending' AS status FROM nodes WHERE node_type = 'function' AND http_method IS NOT NULL AND auth_scheme IS NULL")
def _(g):
    return rules.gather(g, ["insecure_endpoint"]).select("source_urn", "heuristic_name", "status")


@query("h4_vulnerable_dependency", """
, named AS (SELECT urn, sha1(unhex('11b3779d5ba853a79143182651da22f8') || encode(urn || ':vulnerable_dependency')) AS h FROM nodes WHERE cve_ids IS NOT NULL)
SELECT urn AS source_urn, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS id FROM named""")
def _(g):
    return rules.gather(g, ["vulnerable_dependency"]).select("source_urn", "id")


@query("h7_a6_open_candidates", """
SELECT 'insecure_endpoint' AS heuristic_name, count(*) AS n FROM nodes WHERE http_method IS NOT NULL AND auth_scheme IS NULL AND urn NOT IN (SELECT from_urn FROM edges WHERE edge_type = 'calls')
UNION ALL SELECT 'vulnerable_dependency', count(*) FROM nodes WHERE cve_ids IS NOT NULL""")
def _(g):
    """Functions that call something count as already reviewed."""
    found = rules.gather(g, ["insecure_endpoint", "vulnerable_dependency"])
    log = g.edges_of("calls").select(
        F.col("from_urn").alias("urn"), F.lit(1).alias("seq"), F.lit('{"insecure_endpoint_last_evaluated_at": "2024-01-01"}').alias("patch")
    )
    marked = mutate.apply_patches(g.of_type("function"), mutate.merged_patches(log.distinct()), ["insecure_endpoint_last_evaluated_at"])
    left = rules.drop_evaluated(found, Graph(marked, g.edges_of("calls")), ["insecure_endpoint"])
    return rules.candidate_histogram(left)


@query("k6_k7_candidate_report", """
, last AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1)
SELECT coalesce(status, 'pending') AS outcome, count(*) AS n FROM nodes LEFT JOIN last ON urn = 'urn:tpch:party:::customer/' || o_custkey
WHERE http_method IS NOT NULL AND auth_scheme IS NULL GROUP BY 1""")
def _(g):
    """Orders act as status updates of their customer's candidate; the last one counts."""
    found = rules.gather(g, ["insecure_endpoint"])
    orders = g.tables.orders.selectExpr(f"{customer_urn('o_custkey')} as urn", "o_orderkey as seq", "o_orderstatus as status")
    updates = orders.select(ids.candidate_id(F.col("urn"), "insecure_endpoint").alias("id"), "seq", "status")
    return report(with_status(found, updates).withColumnRenamed("status", "outcome"))


@query("k1_k3_store_round_trip", """
SELECT 'node' AS part, node_type AS kind, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY 2""")
def _(g):
    """Write the graph as a version of a store and count it from there."""
    store = ParquetStore(g.spark, f"{shared_folder(g.spark)}/store-{uuid.uuid4().hex}")
    kept = store.read(store.write(g))
    count = lambda df, part, kind: df.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "kind", "n")
    return count(kept.nodes, "node", "node_type").unionByName(count(kept.edges, "edge", "edge_type"))


def _requests(t: Tables) -> DataFrame:
    """Link requests from orders: customer -> part; levels and types vary, some are invalid."""
    return t.orders.selectExpr(
        f"{customer_urn('o_custkey')} as from_urn", "concat('urn:tpch:geo:::nation/', o_orderkey % 30) as to_urn",
        "case o_orderstatus when 'O' then 'reads' when 'F' then 'soft_reference' else 'hosts' end as edge_type",
        "case when o_orderpriority = '1-URGENT' then 'HIGH' when o_orderpriority = '2-HIGH' then 'bogus' else 'medium' end as confidence_level",
        "o_orderpriority as note", "cast(o_orderdate as string) as created_at",
    )


_REQUESTS = """
, requests AS (SELECT 'urn:tpch:party:::customer/' || o_custkey AS from_urn, 'urn:tpch:geo:::nation/' || (o_orderkey % 30) AS to_urn,
  CASE o_orderstatus WHEN 'O' THEN 'reads' WHEN 'F' THEN 'soft_reference' ELSE 'hosts' END AS edge_type,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'HIGH' WHEN o_orderpriority = '2-HIGH' THEN 'BOGUS' ELSE 'MEDIUM' END AS level FROM orders)
, valid AS (SELECT DISTINCT from_urn, to_urn, edge_type FROM requests WHERE to_urn IN (SELECT urn FROM vertices) AND from_urn IN (SELECT urn FROM vertices)
  AND edge_type IN ('reads', 'soft_reference') AND level IN ('HIGH', 'MEDIUM'))
"""


def _document(g) -> Graph:
    """The graph written as one JSON document, with links, in compressed parts, and loaded from it by byte ranges."""
    folder = f"{shared_folder(g.spark)}/document-{uuid.uuid4().hex}"
    graph_json.write_document(soft_links.add_soft_links(g, _requests(g.tables)), folder, "2024-01-01", "gzip")
    return graph_json.load_document(g.spark, folder)


@query("k1_s1_document_nodes", """
SELECT urn, parent_urn, node_type, function_name, file_path, table_name, column_name, package_version, cve_ids, role_superuser FROM nodes""")
def _(g):
    back = _document(g).nodes
    keys = "function_name file_path table_name column_name package_version cve_ids role_superuser".split()
    return back.select("urn", "parent_urn", "node_type", *[meta.get(back, k).alias(k) for k in keys])


@query("k1_s1_document_edges", _REQUESTS + """
SELECT from_urn, to_urn, edge_type, confidence FROM edges
UNION ALL SELECT from_urn, to_urn, 'soft ' || edge_type, CAST(NULL AS DOUBLE) FROM valid""")
def _(g):
    back = _document(g)
    edges = back.edges.select("from_urn", "to_urn", "edge_type", meta.get(back.edges, "confidence").alias("confidence"))
    return edges.unionAll(back.soft_links.select("from_urn", "to_urn", F.concat(F.lit("soft "), F.col("edge_type")), F.lit(None).cast("double")))


# --- mutations and links ---------------------------------------------------------


@query("m1_metadata_updates", """
, log AS (SELECT user_id, event_id, event_type, value FROM events)
SELECT n.urn, n.role_name, arg_max(event_type, event_id) AS io_type, arg_max(event_id, event_id) AS size_bytes
FROM nodes n JOIN log ON 'urn:tpch:catalog:::roles/' || user_id = n.urn GROUP BY ALL""")
def _(g):
    """Every event updates two keys of its user's node; the last event wins."""
    patch = F.to_json(F.struct(F.col("event_type").alias("io_type"), F.col("event_id").alias("size_bytes")))
    log = g.tables.events.select(
        F.concat(F.lit("urn:tpch:catalog:::roles/"), F.col("user_id").cast("string")).alias("urn"), F.col("event_id").alias("seq"), patch.alias("patch")
    )
    out = mutate.apply_patches(g.of_type("identity"), mutate.merged_patches(log), ["io_type", "size_bytes"])
    return out.select("urn", *[meta.get(out, k).alias(k) for k in ("role_name", "io_type", "size_bytes")])


@query("m2_metadata_deletes", "SELECT urn, function_name, CASE WHEN urn <> 'urn:tpch:party:::customer/81' THEN file_path END AS file_path FROM nodes WHERE node_type = 'function'")
def _(g):
    out = mutate.delete_node_metadata(g.of_type("function"), CUSTOMER, "file_path", "no_such_key")
    return out.select("urn", *[meta.get(out, k).alias(k) for k in ("function_name", "file_path")])


@query("m3_soft_link_checks", _REQUESTS + """
SELECT CASE WHEN from_urn NOT IN (SELECT urn FROM vertices) THEN 'from' WHEN to_urn NOT IN (SELECT urn FROM vertices) THEN 'to_urn not found' WHEN edge_type = 'hosts' THEN 'invalid edge_type'
  WHEN level = 'BOGUS' THEN 'invalid confidence' ELSE 'ok' END AS verdict, count(*) AS n FROM requests GROUP BY 1""")
def _(g):
    checked = soft_links.check_links(g, _requests(g.tables))
    verdict = F.coalesce(F.regexp_extract("error", r"^(to_urn not found|invalid \w+)", 1), F.lit("ok"))
    return checked.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("m4_list_soft_links", _REQUESTS + """
SELECT v.edge_type, f.node_type AS from_type, lf.label AS from_label, t.node_type AS to_type, lt.label AS to_label FROM valid v
JOIN nodes f ON f.urn = v.from_urn JOIN nodes t ON t.urn = v.to_urn JOIN labels_of lf ON lf.urn = v.from_urn JOIN labels_of lt ON lt.urn = v.to_urn""")
def _(g):
    linked = soft_links.add_soft_links(g, _requests(g.tables))
    return soft_links.list_soft_links(linked).select("edge_type", "from_type", "from_label", "to_type", "to_label")


@query("m5_remove_soft_links", _REQUESTS + "SELECT from_urn, to_urn, edge_type FROM valid WHERE edge_type <> 'reads'")
def _(g):
    linked = soft_links.add_soft_links(g, _requests(g.tables))
    gone = linked.soft_links.filter("edge_type = 'reads'").select("id")
    return soft_links.link_edges(soft_links.remove_soft_links(linked, gone)).select("from_urn", "to_urn", "edge_type")


@query("k5_store_changes", _REQUESTS + """
, failed AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')
, last AS (SELECT user_id, arg_max(event_type, event_id) AS io_type, arg_max(event_id, event_id) AS size_bytes FROM events GROUP BY 1)
SELECT 'node' AS part, urn AS a, CASE WHEN f.user_id IS NULL THEN io_type END AS b, CAST(size_bytes AS VARCHAR) AS c
FROM nodes JOIN last l ON 'urn:tpch:catalog:::roles/' || l.user_id = urn LEFT JOIN failed f ON f.user_id = l.user_id
UNION ALL SELECT 'link', from_urn, to_urn, edge_type FROM valid WHERE edge_type <> 'reads'
UNION ALL SELECT 'kept', node_type, CAST(count(*) AS VARCHAR), CAST(NULL AS VARCHAR) FROM nodes GROUP BY node_type""")
def _(g):
    """All four changes of a store, each written beside the scanned graph, and what is read back."""
    store = ParquetStore(g.spark, f"{shared_folder(g.spark)}/store-{uuid.uuid4().hex}")
    store.write(g)
    events = g.tables.events.withColumn("urn", F.concat(F.lit("urn:tpch:catalog:::roles/"), F.col("user_id").cast("string")))
    patch = F.to_json(F.struct(F.col("event_type").alias("io_type"), F.col("event_id").alias("size_bytes")))
    store.update_node_metadata(events.select("urn", F.col("event_id").alias("seq"), patch.alias("patch")))
    store.delete_node_metadata(events.filter("event_type = 'error'").select("urn", F.lit("io_type").alias("key")))
    store.add_soft_links(_requests(g.tables))
    store.remove_soft_links(store.read().soft_links.filter("edge_type = 'reads'"))
    kept = store.read()
    people = kept.of_type("identity")
    none = F.lit(None).cast("string")
    nodes = people.select(F.lit("node").alias("part"), F.col("urn").alias("a"), meta.get(people, "io_type").alias("b"), meta.get(people, "size_bytes").cast("string").alias("c"))
    links = kept.soft_links.select(F.lit("link"), "from_urn", "to_urn", "edge_type")
    counts = kept.nodes.groupBy("node_type").agg(F.count("*").alias("n")).select(F.lit("kept"), "node_type", F.col("n").cast("string"), none)
    return nodes.unionAll(links).unionAll(counts)


@query("m6_m8_compliance_export", """
SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity FROM lineitem l WHERE l_orderkey IN
  (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7))""", graph=False)
def _(t):
    people = compliance.select_sentinel(t.customer, ["c_nationkey"], 7)
    orders = compliance.follow_key(t.orders, people, ["o_custkey"], ["c_custkey"])
    lines = compliance.follow_key(t.lineitem, orders, ["l_orderkey"], ["o_orderkey"])
    return compliance.select_by_key(t.lineitem, lines, ["l_orderkey", "l_linenumber"]).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"
    )


@query("m9_compliance_delete", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)""", graph=False)
def _(t):
    people = compliance.select_sentinel(t.customer, ["c_nationkey"], 7)
    orders = compliance.follow_key(t.orders, people, ["o_custkey"], ["c_custkey"])
    return compliance.survivors(t.orders, orders, ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice")


@query("m10_compliance_outcome", "SELECT count(*) AS rows_affected FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)", graph=False)
def _(t):
    people = compliance.select_sentinel(t.customer, ["c_nationkey"], 7)
    return compliance.outcome(compliance.follow_key(t.orders, people, ["o_custkey"], ["c_custkey"]))


__all__ = ["ORACLES", "QUERIES", "enriched_market"]
