"""Registered queries over the derived source tree, containers, lock files and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.build import node_frame
from palisade.functions import docker, meta, scalars
from palisade.model import Graph, union_all
from palisade.operators import rules, security
from palisade.operators.stitch import code, containers
from palisade.plans import tree
from palisade.plans.tables import Tables
from palisade.sources import catalog, lockfile, plugins
from palisade.sources.code import dependency_links, repo_parts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

APP = "'urn:local:codebase:derived:_:app"


def query(name: str, sql: str | None = None, build=Tables):
    def wrap(fn):
        QUERIES[name] = lambda spark, folder: fn(build(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def _edges(edges: DataFrame, *keys: str) -> DataFrame:
    return edges.select("from_urn", "to_urn", "edge_type", *[meta.get(edges, k).alias(k) for k in keys])


# --- code scan ----------------------------------------------------------------------


@query("s4_s6_code_nodes", f"""
SELECT {APP}' AS urn, NULL AS parent_urn, 'codebase' AS node_type, NULL AS start_line, NULL AS end_line
UNION ALL SELECT {APP}/main.py', {APP}', 'file', NULL, NULL
UNION ALL SELECT {APP}/deploy/n' || n_nationkey || '/Dockerfile', {APP}', 'file', NULL, NULL FROM nation
UNION ALL SELECT {APP}/models/m' || s_suppkey || '.py', {APP}', 'file', NULL, NULL FROM supplier JOIN part ON p_partkey = s_suppkey
UNION ALL SELECT {APP}/models/m' || s_suppkey || '.py/Model' || s_suppkey, {APP}/models/m' || s_suppkey || '.py', 'class', 3, 7 FROM supplier JOIN part ON p_partkey = s_suppkey
UNION ALL SELECT {APP}/models/m' || s_suppkey || '.py/Model' || s_suppkey || '/label', {APP}/models/m' || s_suppkey || '.py/Model' || s_suppkey, 'function', 6, 7 FROM supplier JOIN part ON p_partkey = s_suppkey
UNION ALL SELECT {APP}/views/v' || c_custkey || '.py', {APP}', 'file', NULL, NULL FROM customer
UNION ALL SELECT {APP}/views/v' || c_custkey || '.py/helper', {APP}/views/v' || c_custkey || '.py', 'function', 11, 12 FROM customer
UNION ALL SELECT {APP}/views/v' || c_custkey || '.py/fetch', {APP}/views/v' || c_custkey || '.py', 'function', 15, 16 FROM customer
UNION ALL SELECT {APP}/views/v' || c_custkey || '.py/read_' || c_custkey, {APP}/views/v' || c_custkey || '.py', 'function', 21,
  24 + CASE c_mktsegment WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 2 ELSE 0 END FROM customer""", tree.code_scan)
def _(scan):
    n = scan.nodes()
    return n.select("urn", "parent_urn", "node_type", meta.get(n, "start_line").alias("start_line"), meta.get(n, "end_line").alias("end_line"))


@query("f13_f18_function_tags", f"""
SELECT {APP}/views/v' || c_custkey || '.py/read_' || c_custkey AS urn, NULL AS io, 'GET' AS http_method, '/items/{{id}}' AS route_path,
  CASE WHEN c_custkey = 1 THEN '/v1' ELSE '' END || '/c' || c_custkey || '/items/{{id}}' AS full_route_path,
  CASE WHEN c_acctbal >= 5000 THEN 'HTTPBearer' WHEN c_acctbal < 0 THEN 'HTTPBasic' END AS auth_scheme,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'add,commit,query' ELSE 'query' END AS orm_operations, CASE WHEN c_mktsegment = 'BUILDING' THEN 'read,write' ELSE 'read' END AS orm_operation_type,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'get_object,put_object' END AS aws_s3_operations, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'read,write' END AS aws_s3_operation_type,
  CASE WHEN c_nationkey IN (SELECT s_suppkey FROM supplier) THEN 'Model' || c_nationkey END AS orm_models FROM customer
UNION ALL SELECT {APP}/views/v' || c_custkey || '.py/helper', 'ingress/env', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM customer
UNION ALL SELECT {APP}/views/v' || c_custkey || '.py/fetch', 'egress/network', NULL, NULL, NULL, NULL, 'get', 'read', NULL, NULL, NULL FROM customer
UNION ALL SELECT {APP}/models/m' || s_suppkey || '.py/Model' || s_suppkey || '/label', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM supplier""", tree.code_scan)
def _(scan):
    return scan.function_tags.select(
        "urn", F.concat_ws("/", "io_direction", "io_type").alias("io"), "http_method", "route_path", "full_route_path", "auth_scheme",
        "orm_operations", "orm_operation_type", "aws_s3_operations", "aws_s3_operation_type", "orm_models",
    ).withColumn("io", F.nullif("io", F.lit("")))


@query("f23_f24_code_calls", f"""
SELECT {APP}/views/v' || c_custkey || '.py/read_' || c_custkey AS from_urn, {APP}/views/v' || c_custkey || '.py/helper' AS to_urn, 'calls' AS edge_type FROM customer
UNION ALL SELECT {APP}/views/v' || c_custkey || '.py/read_' || c_custkey, {APP}/models/m' || s_suppkey || '.py/Model' || s_suppkey, 'instantiates' FROM customer JOIN supplier ON s_suppkey = c_nationkey""", tree.code_scan)
def _(scan):
    return _edges(scan.call_edges())


def _scripts(extension: str, rows: list[tuple[str, str, int, int, int | None]]) -> None:
    """Definitions of files in one language; ``rows``: path, type, first line, last line, last line where the file is torn (None: the same)."""
    parts = [
        f"SELECT {APP}/src/c' || c_custkey || '.{extension}/' || replace('{path}', '#', c_custkey::VARCHAR) AS urn, '{kind}' AS node_type, {start} AS start_line, "
        f"CASE WHEN c_acctbal < 0 THEN {end if torn is None else torn} ELSE {end} END AS end_line FROM customer"
        for path, kind, start, end, torn in rows
    ]

    @query(f"s6_definitions_{extension}", " UNION ALL ".join(parts), lambda spark, folder: tree.script_scan(spark, folder, extension))
    def _(scan):
        n = scan.nodes().filter("node_type in ('class', 'function')")
        return n.select("urn", "node_type", meta.get(n, "start_line").alias("start_line"), meta.get(n, "end_line").alias("end_line"))


_scripts("js", [
    ("Store#", "class", 2, 5, None), ("Store#/load", "function", 3, 3, None), ("Store#/total", "function", 4, 4, None), ("run#", "function", 6, 8, None),
    ("Cut#", "class", 9, 12, 10), ("Cut#/open", "function", 10, 11, 10),
])
_scripts("ts", [
    ("Repo#", "class", 1, 5, None), ("Repo#/find", "function", 2, 2, None), ("Repo#/over", "function", 4, 4, None), ("pick#", "function", 6, 7, None),
    ("Cut#", "class", 8, 11, 9), ("Cut#/open", "function", 9, 10, 9),
])
_scripts("java", [
    ("Order#", "class", 1, 7, None), ("Order#/label", "function", 2, 3, None), ("Order#/area", "function", 5, 5, None), ("Order#/Inner", "class", 6, 6, None),
    ("Order#/Inner/go", "function", 6, 6, None), ("Cut#", "class", 8, 11, 9), ("Cut#/open", "function", 9, 10, 9),
])


@query("f25_rust_calls", f"""
SELECT {APP}/src/m' || s.s_suppkey || '.rs/f' || s.s_suppkey AS from_urn, {APP}/src/m' || n.s_suppkey || '.rs/f' || n.s_suppkey AS to_urn, 'calls' AS edge_type FROM supplier s JOIN supplier n ON n.s_suppkey = s.s_nationkey
UNION ALL SELECT {APP}/src/m' || s_suppkey || '.rs/f' || s_suppkey, {APP}/src/m' || s_suppkey || '.rs/helper', 'calls' FROM supplier""", tree.rust_scan)
def _(scan):
    return _edges(scan.call_edges()).distinct()


@query("f14_orm_model_references", f"""
SELECT {APP}/views/v' || c_custkey || '.py/read_' || c_custkey AS urn, 'Model' || s_suppkey AS name, {APP}/models/m' || s_suppkey || '.py/Model' || s_suppkey AS class_urn
FROM customer JOIN supplier ON s_suppkey = c_nationkey""", tree.code_scan)
def _(scan):
    return scan.model_references(scan.function_tags).select("urn", "name", "class_urn")


_DOCKER = f"""
WITH d AS (SELECT n_nationkey AS k, {APP}/deploy/n' || n_nationkey || '/Dockerfile' AS urn, CASE n_regionkey WHEN 0 THEN '["python3", "/srv/views/v' || n_nationkey || '.py"]' WHEN 3 THEN '["$HOME/v' || n_nationkey || '"]' END AS entry,
  CASE n_regionkey WHEN 1 THEN 'python views/v' || n_nationkey || '.py' WHEN 2 THEN '["uvicorn", "--reload", "views.v' || n_nationkey || ':router"]' END AS cmd, n_regionkey FROM nation)
"""


@query("f21_dockerfile_tags", _DOCKER + "SELECT urn, 'golang:1.22,python:3.' || k AS base_images, entry, cmd, '/srv' AS workdir, '/srv' AS copies FROM d", tree.code_scan)
def _(scan):
    n = scan.file_nodes()
    keys = {"base_images": "dockerfile_base_images", "entry": "dockerfile_entrypoint", "cmd": "dockerfile_cmd", "workdir": "dockerfile_workdir", "copies": "dockerfile_copy_targets"}
    return n.filter(meta.present(n, "dockerfile_base_images")).select("urn", *[meta.get(n, k).alias(a) for a, k in keys.items()])


def _code_files(spark, folder):
    scan = tree.code_scan(spark, folder)
    nodes = scan.file_nodes()
    return Graph(nodes, nodes.limit(0).selectExpr("urn as from_urn", "urn as to_urn", "'x' as edge_type"))


@query("j4_dockerfile_to_entrypoint", _DOCKER + f"SELECT urn AS from_urn, {APP}/views/v' || k || '.py' AS to_urn, 'executes' AS edge_type FROM d WHERE n_regionkey IN (0, 1, 2) AND k IN (SELECT c_custkey FROM customer)", _code_files)
def _(g):
    return _edges(containers.dockerfile_to_entrypoint(g))


def _linked_code(spark, folder):
    g = _code_files(spark, folder)
    return Graph(g.nodes, containers.dockerfile_to_entrypoint(g))


@query("h5_unlinked_entrypoint", _DOCKER + "SELECT urn AS source_urn, 'unlinked_entrypoint' AS heuristic_name FROM d WHERE n_regionkey = 3", _linked_code)
def _(g):
    return rules.gather(g, ["unlinked_entrypoint"]).select("source_urn", "heuristic_name")


# --- ORM and functions to tables -------------------------------------------------------


def _orm_graph(spark, folder):
    """ORM classes named after suppliers and pages' hosts, and the part tables."""
    t = Tables(spark, folder)
    orm = t.part.selectExpr("p_partkey as k", "p_name")
    hosts = t.pages.selectExpr("page_id as k", "regexp_extract(url, '([^./]+)[.]example[.]', 1) as host").join(orm, "k")
    classes = [
        node_frame(t.supplier.join(orm.withColumnRenamed("k", "s_suppkey"), "s_suppkey"), "class", "concat('urn:c:::::s', s_suppkey)", None, "s_suppkey", class_name="concat('S', s_nationkey)", orm_table="p_name"),
        node_frame(hosts, "class", "concat('urn:c:::::h', k)", None, "1000000 + k", class_name="host", orm_table="p_name"),
    ]
    nodes = union_all([*classes, tree.tables_of_parts(t)])
    return Graph(nodes, nodes.limit(0)), t


_ORM = """
WITH tab AS (SELECT p_name, arg_min('urn:tpch:catalog:::' || p_brand || '/' || p_partkey, p_partkey) AS to_urn FROM part GROUP BY 1)
, cls AS (SELECT 'urn:c:::::s' || s_suppkey AS urn, s_suppkey AS ord, 'S' || s_nationkey AS name, p_name FROM supplier JOIN part ON p_partkey = s_suppkey
  UNION ALL SELECT 'urn:c:::::h' || page_id, 1000000 + page_id, regexp_extract(url, '([^./]+)[.]example[.]', 1), p_name FROM pages JOIN part ON p_partkey = page_id)
, orm AS (SELECT name, arg_max(urn, ord) AS from_urn, arg_max(p_name, ord) AS p_name FROM cls GROUP BY 1)
"""


@query("j1_orm_class_to_table", _ORM + "SELECT from_urn, to_urn, 'models' AS edge_type, name AS orm_class FROM orm JOIN tab USING (p_name)", _orm_graph)
def _(built):
    return _edges(code.orm_class_to_table(built[0]), "orm_class")


@query("j2_function_to_table", _ORM + """
SELECT 'urn:f:::::' || doc_id AS from_urn, to_urn, 'reads' AS edge_type, name AS referenced_model FROM documents JOIN orm ON contains(text, name) JOIN tab USING (p_name) WHERE text <> ''""", _orm_graph)
def _(built):
    """Documents stand in for function texts; whole texts are searched."""
    g, t = built
    texts = t.documents.selectExpr("concat('urn:f:::::', doc_id) as id", "doc_id as ord", "text").filter("text <> ''")
    return _edges(code.function_texts_to_tables(g, texts), "referenced_model")


def _many_models(spark, folder):
    """A model class for each document, named after its first long word, so the dictionary grows with the texts."""
    t = Tables(spark, folder)
    named = t.documents.selectExpr("doc_id as k", "regexp_extract(text, '([A-Za-z]{6,})', 1) as word").filter("word <> ''")
    named = named.join(t.part.selectExpr("p_partkey as k", "p_name"), "k")
    classes = node_frame(named, "class", "concat('urn:c:::::d', k)", None, "k", class_name="word", orm_table="p_name")
    nodes = union_all([classes, tree.tables_of_parts(t)])
    return Graph(nodes, nodes.limit(0)), t


@query("j2_models_of_all_documents", """
WITH tab AS (SELECT p_name, arg_min('urn:tpch:catalog:::' || p_brand || '/' || p_partkey, p_partkey) AS to_urn FROM part GROUP BY 1)
, cls AS (SELECT doc_id AS ord, regexp_extract(text, '([A-Za-z]{6,})', 1) AS name, p_name FROM documents JOIN part ON p_partkey = doc_id)
, orm AS (SELECT name, arg_max(p_name, ord) AS p_name FROM cls WHERE name <> '' GROUP BY 1)
SELECT 'urn:f:::::' || doc_id AS from_urn, to_urn, 'reads' AS edge_type, name AS referenced_model FROM documents JOIN orm ON contains(text, name) JOIN tab USING (p_name) WHERE text <> ''""", _many_models)
def _(built):
    g, t = built
    texts = t.documents.selectExpr("concat('urn:f:::::', doc_id) as id", "doc_id as ord", "text").filter("text <> ''")
    return _edges(code.function_texts_to_tables(g, texts), "referenced_model")


# --- containers ---------------------------------------------------------------------------

_BUILDS = """
WITH repo AS (SELECT 's' || s_suppkey || '/n' || s_suppkey || CASE WHEN s_acctbal < 2000 THEN '' WHEN s_acctbal < 4000 THEN '-api' WHEN s_acctbal < 6000 THEN '_web' ELSE '-worker' END AS name,
  s_suppkey, s_nationkey, 'urn:arn:aws:ecr:r:1:repository/s' || s_suppkey AS urn FROM supplier)
, oci AS (SELECT repo.*, k AS base FROM repo JOIN (SELECT DISTINCT c_custkey // 10 AS k FROM customer) ON k = s_suppkey WHERE s_nationkey < 5)
, guess AS (SELECT repo.*, s_suppkey AS base FROM repo WHERE name NOT LIKE '%-worker' AND urn NOT IN (SELECT urn FROM oci))
, files AS (SELECT 'urn:git:repo:git.example.com:_:n' || (c_custkey // 10) || '/svc' || c_custkey || '/Dockerfile' AS file, c_custkey // 10 AS file_base, c_mktsegment, c_acctbal FROM customer)
"""


@query("j3_dockerfile_to_image_repo", _BUILDS + """
SELECT file AS from_urn, urn AS to_urn, 'builds' AS edge_type, 'oci_label' AS detection_method FROM oci JOIN files ON file_base = base WHERE c_mktsegment <> 'HOUSEHOLD'
UNION ALL SELECT file, urn, 'builds', 'name_heuristic' FROM guess JOIN files ON file_base = base WHERE c_mktsegment <> 'HOUSEHOLD'""", tree.container_graph)
def _(g):
    return _edges(containers.dockerfile_to_image_repo(g), "detection_method")


@query("h1_unlinked_dockerfile", _BUILDS + "SELECT file AS source_urn FROM files WHERE c_mktsegment <> 'HOUSEHOLD'", tree.container_graph)
def _(g):
    return rules.gather(g, ["unlinked_dockerfile"]).select("source_urn")


@query("h1_unlinked_dockerfile_strict", _BUILDS + "SELECT file AS source_urn FROM files WHERE c_mktsegment <> 'HOUSEHOLD' AND c_acctbal >= 0", tree.container_graph)
def _(g):
    return rules.gather(g, ["unlinked_dockerfile"], strict=True).select("source_urn")


@query("h2_orphaned_ecr_repo", _BUILDS + "SELECT urn AS source_urn FROM repo", tree.container_graph)
def _(g):
    return rules.gather(g, ["orphaned_ecr_repo"]).select("source_urn")


def _built(spark, folder):
    g = tree.container_graph(spark, folder)
    return Graph(g.nodes, containers.dockerfile_to_image_repo(g))


@query("h2_orphaned_ecr_repo_strict", _BUILDS + """
SELECT urn AS source_urn FROM repo WHERE urn NOT IN (SELECT urn FROM (SELECT urn, base FROM oci UNION ALL SELECT urn, base FROM guess) b JOIN files ON file_base = base WHERE c_mktsegment <> 'HOUSEHOLD')""", _built)
def _(g):
    """Repositories that no Dockerfile is known to build."""
    return rules.gather(g, ["orphaned_ecr_repo"], strict=True).select("source_urn")


# --- lock files -----------------------------------------------------------------------------

_LOCK = """
WITH pkg AS (SELECT DISTINCT 'urn:tpch:code:::' || p_brand AS base, p_type, p_size FROM part)
"""


def _lock(t: Tables) -> Graph:
    return lockfile.load_lock(lockfile.packages(tree.lock_rows(t)), tree.osv_extract(t))


@query("s9_s10_lock_nodes", _LOCK + """
SELECT base || '/dep/' || lower(p_type) || '-' || p_size AS urn, base || '/uv.lock' AS parent_urn, '1.' || p_size AS package_version,
  CASE WHEN p_type = 'PROMO' THEN 'CVE-2023-' || p_size || ',CVE-2024-' || p_size END AS cve_ids FROM pkg
UNION ALL SELECT DISTINCT base || '/uv.lock', base, NULL, NULL FROM pkg""")
def _(t):
    n = _lock(t).nodes
    return n.select("urn", "parent_urn", meta.get(n, "package_version").alias("package_version"), meta.get(n, "cve_ids").alias("cve_ids"))


@query("s9_lock_edges", _LOCK + """
SELECT base || '/uv.lock' AS from_urn, base || '/dep/' || lower(p_type) || '-' || p_size AS to_urn, 'depends_on' AS edge_type FROM pkg
UNION ALL SELECT DISTINCT base, base || '/uv.lock', 'contains' FROM pkg
UNION ALL SELECT a.base || '/dep/' || lower(a.p_type) || '-' || a.p_size, b.base || '/dep/' || lower(b.p_type) || '-' || b.p_size, 'depends_on' FROM pkg a JOIN pkg b ON a.base = b.base AND a.p_type = b.p_type AND b.p_size = a.p_size + 1""")
def _(t):
    return _edges(_lock(t).edges)


_KNOWN = f"""
WITH version AS (SELECT DISTINCT lower(split_part(p_type, ' ', 1)) AS name, CASE WHEN p_type LIKE 'P%' AND p_size % 2 = 1 THEN '2.0' ELSE '1.0' END AS version FROM part)
, bad AS (SELECT name, version, cve_ids FROM version JOIN (SELECT lower(split_part(p_type, ' ', 1)) AS name, '2.0' AS version, string_agg(DISTINCT 'CVE-2024-' || p_size, ',' ORDER BY 'CVE-2024-' || p_size) AS cve_ids
    FROM part WHERE p_type LIKE 'P%' GROUP BY 1) USING (name, version))
, dep AS (SELECT name, version, {APP}/dep/' || name || CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN '@' || version ELSE '' END AS urn FROM version)
, importer AS (SELECT 'lib/c' || c_custkey || '.py' AS file_path, CASE c_mktsegment WHEN 'BUILDING' THEN 'economy' WHEN 'MACHINERY' THEN 'promo' ELSE 'medium' END AS name FROM customer)
"""


def _vulnerable(spark, folder):
    scan, lock, known = tree.vulnerable_tree(spark, folder)
    return scan.graph_with_lock(lockfile.packages(lock), known)


@query("x4_vulnerable_code_of_tree", _KNOWN + """
SELECT b.name AS package, b.version, cve_ids, file_path FROM bad b JOIN importer USING (name)
UNION ALL SELECT b.name, b.version, cve_ids, 'urn:local:codebase:derived:_:app/uv.lock' FROM bad b
UNION ALL SELECT b.name, b.version, cve_ids, d.urn FROM bad b, dep d WHERE b.name = 'promo' AND d.name <> 'promo'""", _vulnerable)
def _(g):
    """What a scanned tree has to do with vulnerable versions: files, the lock file, other packages."""
    return security.find_vulnerable_code(g)


@query("h4_vulnerable_dependency_of_tree", _KNOWN + """
SELECT urn AS source_urn, 'vulnerable_dependency' AS heuristic_name, cve_ids FROM bad JOIN dep USING (name, version)""", _vulnerable)
def _(g):
    found = rules.gather(g, ["vulnerable_dependency"])
    return found.select("source_urn", "heuristic_name", F.get_json_object("source_metadata", "$.cve_ids").alias("cve_ids"))


@query("s9_versions_side_by_side", _KNOWN + f"""
SELECT {APP}/' || file_path AS from_urn, urn AS to_urn, 'depends_on' AS edge_type FROM importer JOIN dep USING (name)
UNION ALL SELECT {APP}/uv.lock', urn, 'depends_on' FROM dep
UNION ALL SELECT d.urn, p.urn, 'depends_on' FROM dep d, dep p WHERE d.name <> 'promo' AND p.name = 'promo' AND p.version = '2.0'""", _vulnerable)
def _(g):
    return _edges(g.edges_of("depends_on"))


@query("f22_dependency_links", f"""
SELECT {APP}/views/v' || c_custkey || '.py' AS from_urn, 'urn:d:' || name AS to_urn, 'depends_on' AS edge_type FROM customer, (VALUES ('boto3'), ('FastAPI'), ('sqlalchemy')) d(name)
UNION ALL SELECT {APP}/models/m' || s_suppkey || '.py', 'urn:d:sqlalchemy', 'depends_on' FROM supplier JOIN part ON p_partkey = s_suppkey
UNION ALL SELECT {APP}/main.py', 'urn:d:FastAPI', 'depends_on'""")
def _(t):
    deps = t.spark.range(1).selectExpr("inline(array(struct('boto3' as n, 1L as ord), struct('FastAPI' as n, 2L as ord), struct('sqlalchemy' as n, 3L as ord), struct('unused-lib' as n, 4L as ord)))").selectExpr(
        "concat('urn:d:', n) as urn", "ord", "struct(n as package_name) as metadata"
    )
    files = tree.source_files(t).filter("language = 'python'").select(F.concat(F.lit("urn:local:codebase:derived:_:app/"), "file_path").alias("urn"), "source")
    return _edges(dependency_links(files, deps))


# --- catalogs ---------------------------------------------------------------------------------


def _catalog(t: Tables) -> Graph:
    return catalog.load_catalog(tree.catalog_frames(t), "shop", "db1", 5432)


_DB = "'urn:onprem:postgres:db1:5432:shop"


@query("s2_f12_catalog_columns", f"""
SELECT {_DB}/' || p_brand || '/t' || p_partkey || '/' || c AS urn, {_DB}/' || p_brand || '/t' || p_partkey AS parent_urn,
  CASE c WHEN 'id' THEN 'bigint(64)' WHEN 'email' THEN CASE WHEN p_size <> 0 THEN 'varchar(' || p_size || ')' ELSE 'varchar' END
    ELSE CASE WHEN p_size % 3 <> 0 THEN 'numeric(10,' || (p_size % 3) || ')' ELSE 'numeric(10)' END END AS data_type, c <> 'id' AS nullable, pos AS ordinal_position
FROM part, (VALUES ('id', 0), ('email', 1), ('price', 2)) cols(c, pos) WHERE p_type <> 'SMALL'""")
def _(t):
    n = _catalog(t).of_type("column")
    return n.select("urn", "parent_urn", *[meta.get(n, k).alias(k) for k in ("data_type", "nullable", "ordinal_position")])


@query("s2_catalog_nodes", f"""
SELECT 'database' AS node_type, count(*) AS n FROM (SELECT 1) UNION ALL SELECT 'schema', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'table', count(*) FROM part WHERE p_type <> 'SMALL'
UNION ALL SELECT 'column', 3 * count(*) FROM part WHERE p_type <> 'SMALL' UNION ALL SELECT 'identity', count(*) FROM (SELECT user_id FROM events GROUP BY 1 HAVING max(value) > 55)""")
def _(t):
    return _catalog(t).nodes.groupBy("node_type").agg(F.count("*").alias("n"))


@query("s2b_foreign_key_edges", f"""
SELECT {_DB}/' || a.p_brand || '/t' || a.p_partkey || '/id' AS from_urn, {_DB}/' || b.p_brand || '/t' || b.p_partkey || '/id' AS to_urn, 'references' AS edge_type, 'fk_' || a.p_partkey AS constraint_name
FROM part a JOIN part b ON b.p_partkey = a.p_partkey - 1""")
def _(t):
    return _edges(_catalog(t).edges_of("references"), "constraint_name")


@query("s2a_grant_edges", f"""
WITH g AS (SELECT user_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k, value > 50 AS grantable,
  CASE event_type WHEN 'view' THEN 'SELECT' WHEN 'click' THEN 'REFERENCES' WHEN 'purchase' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'ALL' END AS p FROM events)
, ways AS (SELECT *, unnest(CASE WHEN p = 'ALL' THEN ['reads', 'writes'] WHEN p IN ('INSERT', 'DELETE') THEN ['writes'] ELSE ['reads'] END) AS way FROM g)
SELECT {_DB}/roles/user_' || user_id AS from_urn, {_DB}/' || p_brand || '/t' || k AS to_urn, way AS edge_type, max(p) AS privilege, string_agg(DISTINCT p, ',' ORDER BY p) AS privileges, bool_or(grantable) AS is_grantable
FROM ways JOIN part ON p_partkey = k WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING max(value) > 55) GROUP BY user_id, k, p_brand, way""")
def _(t):
    e = _catalog(t).edges_of("reads", "writes")
    return _edges(e, "privilege", "privileges", "is_grantable").withColumn("privileges", F.array_join("privileges", ","))


def _usage(t: Tables) -> DataFrame:
    """Key columns: line items' composite keys and orders' keys, as catalog rows."""
    return t.orders.selectExpr(
        "explode(array(struct(concat('pk_', o_orderkey) as name, 'pub' as sch, concat('o', o_orderkey) as tab, 'a' as col, 1 as pos, cast(null as string) as far), "
        "struct(concat('pk_', o_orderkey) as name, 'pub' as sch, concat('o', o_orderkey) as tab, 'b' as col, 2 as pos, cast(null as string) as far), "
        "struct(concat('fk_', o_orderkey) as name, 'pub' as sch, concat('o', o_orderkey) as tab, 'x' as col, 1 as pos, concat('o', o_custkey) as far), "
        "struct(concat('fk_', o_orderkey) as name, 'pub' as sch, concat('o', o_orderkey) as tab, 'y' as col, 2 as pos, concat('o', o_custkey) as far))) as u"
    ).selectExpr(
        "u.name as constraint_name", "u.sch as constraint_schema", "u.sch as table_schema", "u.tab as table_name", "u.col as column_name", "u.pos as ordinal_position",
        "if(u.far is null, null, 'pub') as referenced_table_schema", "u.far as referenced_table_name", "if(u.far is null, null, if(u.pos = 1, 'a', 'b')) as referenced_column_name",
    )


_FK = """
SELECT 'fk_' || o_orderkey AS constraint_name, 'o' || o_orderkey AS fk_table, k.c AS fk_column, 'o' || o_custkey AS ref_table, k.r AS ref_column, k.p AS ordinal_position
FROM orders, (VALUES ('x', 'a', 1), ('y', 'b', 2)) k(c, r, p)"""
_FK_COLUMNS = ["constraint_name", "fk_table", "fk_column", "ref_table", "ref_column", "ordinal_position"]


@query("m11_foreign_keys_postgres", _FK + " WHERE o_custkey IN (SELECT o_orderkey FROM orders)")
def _(t):
    referential = t.orders.selectExpr(
        "concat('fk_', o_orderkey) as constraint_name", "'pub' as constraint_schema", "concat('pk_', o_custkey) as unique_constraint_name", "'pub' as unique_constraint_schema"
    )
    return catalog.foreign_keys_standard(referential, _usage(t)).select(*_FK_COLUMNS)


@query("m11_foreign_keys_mysql", _FK)
def _(t):
    return catalog.foreign_keys_mysql(_usage(t)).select(*_FK_COLUMNS)


@query("m11_foreign_keys_oracle", _FK + " WHERE o_custkey IN (SELECT o_orderkey FROM orders)")
def _(t):
    cons = t.orders.selectExpr(
        "explode(array(struct('R' as ty, concat('fk_', o_orderkey) as n, concat('pk_', o_custkey) as r), struct('P' as ty, concat('pk_', o_orderkey) as n, cast(null as string) as r))) as c",
        "concat('o', o_orderkey) as table_name",
    ).selectExpr("'PUB' as owner", "c.n as constraint_name", "c.ty as constraint_type", "table_name", "'PUB' as r_owner", "c.r as r_constraint_name")
    cols = _usage(t).selectExpr("'PUB' as owner", "constraint_name", "column_name", "ordinal_position as position")
    return catalog.foreign_keys_oracle(cons, cols).select(*_FK_COLUMNS)


@query("m11_constraints", """
SELECT 'pk_' || o_orderkey AS constraint_name, 'PRIMARY_KEY' AS constraint_type, 'o' || o_orderkey AS table_name, k.c AS column_name FROM orders, (VALUES ('a'), ('b')) k(c)
UNION ALL SELECT 'ck_' || o_orderkey, 'CHECK', 'o' || o_orderkey, '' FROM orders""")
def _(t):
    declared = t.orders.selectExpr(
        "explode(array(struct(concat('pk_', o_orderkey) as n, 'PRIMARY KEY' as ty), struct(concat('ck_', o_orderkey) as n, 'CHECK' as ty), struct(concat('fk_', o_orderkey) as n, 'FOREIGN KEY' as ty))) as c",
        "concat('o', o_orderkey) as table_name",
    ).selectExpr("c.n as constraint_name", "'pub' as table_schema", "table_name", "c.ty as constraint_type")
    return catalog.constraints(declared, _usage(t)).select("constraint_name", "constraint_type", "table_name", "column_name")


@query("m11_oracle_tables", "SELECT c_mktsegment AS table_schema, c_name AS table_name, 'BASE_TABLE' AS table_type FROM customer UNION ALL SELECT 'V', s_name, 'VIEW' FROM supplier")
def _(t):
    return catalog.oracle_tables(t.customer.selectExpr("c_mktsegment as owner", "c_name as table_name"), t.supplier.selectExpr("'V' as owner", "s_name as view_name"))


@query("a8_index_columns", """
SELECT o_orderstatus AS table_name, o_orderkey AS index_name, o_orderpriority || ',' || o_custkey || ',' || o_orderstatus AS columns FROM orders""")
def _(t):
    """One three-column index per order, its rows listed in reverse."""
    rows = t.orders.selectExpr(
        "o_orderstatus as table_name", "o_orderkey as index_name",
        "inline(array(struct(o_orderstatus as column_name, 3 as seq_in_index), struct(cast(o_custkey as string) as column_name, 2 as seq_in_index), struct(o_orderpriority as column_name, 1 as seq_in_index)))",
    )
    return catalog.index_columns(rows, ["table_name", "index_name"]).withColumn("columns", F.array_join("columns", ","))


@query("f26_postgres_indexes", """
SELECT c_name AS index_name, CASE c_mktsegment WHEN 'BUILDING' THEN 'GIN' WHEN 'MACHINERY' THEN 'HASH' ELSE 'BTREE' END AS index_type, c_acctbal > 0 AS is_unique,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN 'a,b c' ELSE '' END AS columns FROM customer""")
def _(t):
    text = (
        "concat('CREATE ', if(c_acctbal > 0, 'UNIQUE ', ''), 'INDEX i ON pub.t', c_custkey, case c_mktsegment when 'BUILDING' then ' USING gin (a)' when 'MACHINERY' then ' USING hash (a)' "
        "when 'FURNITURE' then ' (\"a\", b c)' else ' USING btree (a)' end)"
    )
    rows = t.customer.selectExpr("'pub' as schemaname", "concat('t', c_custkey) as tablename", "c_name as indexname", f"{text} as indexdef")
    return catalog.postgres_indexes(rows).select("index_name", "index_type", "is_unique", F.array_join("columns", ",").alias("columns"))


@query("s11_column_sample", "SELECT count(*) AS n, count(DISTINCT value) AS n_distinct FROM (SELECT DISTINCT CAST(o_orderdate AS VARCHAR) AS value FROM orders LIMIT 20)")
def _(t):
    return catalog.sample_values(t.orders, "o_orderdate").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_distinct"))


# --- scalar functions over whole tables -----------------------------------------------------------


@query("f5_path_tags", """
WITH paths AS (SELECT page_id, regexp_replace(url, '^https?://', '') || '/' || CASE page_id % 4 WHEN 0 THEN 'pii' WHEN 1 THEN 'Secrets' WHEN 2 THEN 'addresses.financial' ELSE 'mypiix' END AS path FROM pages)
SELECT page_id, concat_ws(',', CASE WHEN regexp_matches(path, '\\bpii\\b', 'i') THEN 'pii' END, CASE WHEN regexp_matches(path, '\\bsecrets?\\b', 'i') THEN 'secret' END,
  CASE WHEN regexp_matches(path, '\\bfinancial\\b', 'i') THEN 'financial' END, CASE WHEN regexp_matches(path, '\\baddress(es)?\\b', 'i') THEN 'pii.address' END) AS tags FROM paths""")
def _(t):
    word = "case page_id % 4 when 0 then 'pii' when 1 then 'Secrets' when 2 then 'addresses.financial' else 'mypiix' end"
    paths = t.pages.selectExpr("page_id", f"concat(regexp_replace(url, '^https?://', ''), '/', {word}) as path")
    return paths.select("page_id", F.array_join(scalars.path_tags(F.col("path")), ",").alias("tags"))


@query("f9_f10_url_keys", """
SELECT page_id, lower(regexp_replace(regexp_replace(rtrim(url, '/'), '\\.git$', ''), '^https?://', '')) AS repo_key,
  rtrim(regexp_replace(lower(trim(url)), '^https?://', ''), './') AS dns_key FROM pages""")
def _(t):
    return t.pages.select("page_id", scalars.repo_key(F.col("url")).alias("repo_key"), scalars.dns_key(F.col("url")).alias("dns_key"))


_CHECKED_OUT = f"""
WITH own AS (SELECT *, '{tree.CLONE_URN}/src/n' || c_nationkey || '/_v' || c_custkey || '.py' AS file FROM customer WHERE c_acctbal >= 0)
"""


@query("s4_s5_checked_out_nodes", _CHECKED_OUT + f"""
SELECT '{tree.CLONE_URN}' AS urn, 'codebase' AS node_type, '{tree.CLONED}' AS repo_url, '{tree.COMMIT}' AS scanned_commit, (SELECT count(*) + 1 FROM own) AS file_count
UNION ALL SELECT file, 'file', NULL, NULL, NULL FROM own UNION ALL SELECT file || '/f' || c_custkey, 'function', NULL, NULL, NULL FROM own
UNION ALL SELECT '{tree.CLONE_URN}/' || f, CASE WHEN f = 'uv.lock' THEN 'package_manifest' ELSE 'file' END, NULL, NULL, NULL FROM (VALUES ('src/__init__.py'), ('Dockerfile'), ('uv.lock')) v(f)
UNION ALL SELECT DISTINCT '{tree.CLONE_URN}/dep/' || lower(c_mktsegment[1:4]), 'dependency', NULL, NULL, NULL FROM customer""", tree.checked_out)
def _(g):
    """A repository from its files on disk: pruned folders, names that Spark hides, lock file, host and commit."""
    n = g.nodes
    return n.select("urn", "node_type", *[meta.get(n, k).alias(k) for k in ("repo_url", "scanned_commit", "file_count")])


@query("s4_s9_checked_out_imports", _CHECKED_OUT + f"""
SELECT file AS from_urn, '{tree.CLONE_URN}/dep/' || lower(c_mktsegment[1:4]) AS to_urn, 'depends_on' AS edge_type FROM own
UNION ALL SELECT DISTINCT '{tree.CLONE_URN}/uv.lock', '{tree.CLONE_URN}/dep/' || lower(c_mktsegment[1:4]), 'depends_on' FROM customer""", tree.checked_out)
def _(g):
    return _edges(g.edges_of("depends_on"))


_PLUGINS = [
    plugins.CodePlugin("lock", lambda tree, graph: graph, markers=frozenset({"uv.lock"})),
    plugins.CodePlugin("routes", lambda tree, graph: graph, frozenset({"python", "javascript"})),
    plugins.CodePlugin("crates", lambda tree, graph: graph, frozenset({"rust"}), frozenset({"Cargo.toml", "Cargo.lock"})),
]


@query("s12_l8_plugin_choice", """
WITH file AS (SELECT c_nationkey AS k, CASE c_mktsegment WHEN 'BUILDING' THEN 'python' WHEN 'MACHINERY' THEN 'rust' WHEN 'HOUSEHOLD' THEN 'javascript' ELSE 'java' END AS language,
    CASE WHEN c_acctbal < -500 THEN 'uv.lock' WHEN c_acctbal > 9500 THEN 'Cargo.toml' END AS marker FROM customer)
, tree AS (SELECT k, bool_or(language IN ('python', 'javascript')) AS routes, bool_or(language = 'rust') AS rust, coalesce(bool_or(marker = 'uv.lock'), false) AS lock, coalesce(bool_or(marker = 'Cargo.toml'), false) AS cargo,
    CASE k % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'relevant' ELSE 'manual' END AS mode, k % 5 = 4 AS listed FROM file GROUP BY k)
SELECT 'nation' || k AS target, 'lock' AS plugin FROM tree WHERE NOT listed AND (mode = 'all' OR mode = 'relevant' AND lock)
UNION ALL SELECT 'nation' || k, 'routes' FROM tree WHERE routes AND (listed OR mode IN ('all', 'relevant'))
UNION ALL SELECT 'nation' || k, 'crates' FROM tree WHERE rust AND (listed OR mode = 'all' OR mode = 'relevant' AND cargo)""")
def _(t):
    """Nations stand in for trees, customers for their files; every third tree has a mode, every fifth a list of its own."""
    language = "case c_mktsegment when 'BUILDING' then 'python' when 'MACHINERY' then 'rust' when 'HOUSEHOLD' then 'javascript' else 'java' end as language"
    path = "case when c_acctbal < -500 then 'uv.lock' when c_acctbal > 9500 then 'Cargo.toml' else concat('src/', c_custkey) end as file_path"
    trees = plugins.profiles(t.customer.selectExpr("c_nationkey as k", language, path), "k", plugins=_PLUGINS).selectExpr(
        "*", "case k % 3 when 0 then 'all' when 1 then 'relevant' else 'manual' end as mode", "if(k % 5 = 4, array('routes', 'crates'), null) as listed"
    )
    return plugins.choices(trees, _PLUGINS).select(F.concat(F.lit("nation"), F.col("k").cast("string")).alias("target"), "plugin")


@query("s5_repo_url_parts", """
SELECT page_id, lower(regexp_extract(url, '^https?://([^/:]+)', 1)) AS host, trim(regexp_replace(regexp_extract(url, '^https?://[^/]*([^?#]*)', 1), '\\.git$', ''), '/') AS path FROM pages""")
def _(t):
    return t.pages.select("page_id", *repo_parts(F.col("url")))


@query("f7_f8_container_paths", """
WITH c AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN '["python", "-u", "/app/src/m' || c_custkey || '.py"]' WHEN 'MACHINERY' THEN 'uv run pkg.mod' || c_custkey || ':app --port 1'
  WHEN 'FURNITURE' THEN '/usr/bin/node /opt/x/i.js' WHEN 'HOUSEHOLD' THEN 'python $MAIN' ELSE '["sh"]' END AS cmd, c_mktsegment FROM customer)
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN '/app/src/m' || c_custkey || '.py' WHEN 'MACHINERY' THEN 'pkg/mod' || c_custkey || '.py' WHEN 'FURNITURE' THEN '/opt/x/i.js' END AS target,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'src/m' || c_custkey || '.py' WHEN 'MACHINERY' THEN 'pkg/mod' || c_custkey || '.py' WHEN 'FURNITURE' THEN 'i.js' END AS path FROM c""")
def _(t):
    cmd = (
        "case c_mktsegment when 'BUILDING' then concat('[\"python\", \"-u\", \"/app/src/m', c_custkey, '.py\"]') when 'MACHINERY' then concat('uv run pkg.mod', c_custkey, ':app --port 1') "
        "when 'FURNITURE' then '/usr/bin/node /opt/x/i.js' when 'HOUSEHOLD' then 'python $MAIN' else '[\"sh\"]' end as cmd"
    )
    rows = t.customer.selectExpr("c_custkey", cmd).withColumn("target", docker.target_file(F.col("cmd")))
    return rows.select("c_custkey", "target", docker.repo_path(F.col("target"), F.lit("/app/"), F.array(F.lit("/"), F.lit("/opt/x"))).alias("path"))


@query("f11_port_ranges", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'all' WHEN o_orderstatus = 'P' THEN 'None-' || o_custkey WHEN o_orderpriority = '5-LOW' THEN o_custkey || '-None'
  ELSE CAST(o_custkey AS VARCHAR) END AS ports FROM orders""")
def _(t):
    low = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))
    high = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey"))
    return t.orders.select("o_orderkey", scalars.port_range(low, high).alias("ports"))


@query("f27_confidence_levels", """
SELECT o_orderpriority AS level, CASE o_orderpriority WHEN '1-URGENT' THEN 0.95 WHEN '2-HIGH' THEN 0.8 WHEN '3-MEDIUM' THEN 0.6 WHEN '5-LOW' THEN 0.4 END::DOUBLE AS score, count(*) AS n FROM orders GROUP BY ALL""")
def _(t):
    name = F.when(F.col("o_orderpriority") == "1-URGENT", "very_high").otherwise(F.lower(F.regexp_replace("o_orderpriority", r"^\d-", "")))
    scored = t.orders.select(F.col("o_orderpriority").alias("level"), scalars.confidence_score(name).alias("score"))
    return scored.groupBy("level", "score").agg(F.count("*").alias("n"))


@query("f29_action_types", """
SELECT event_type, CASE event_type WHEN 'view' THEN 'SOFT_LINK_ADDED' WHEN 'click' THEN CASE WHEN value > 10 THEN 'EVALUATED_AT_MARKED' ELSE 'METADATA_UPDATED' END WHEN 'error' THEN 'MCP_TOOL_CALL' ELSE 'UNKNOWN' END AS action, count(*) AS n
FROM events GROUP BY ALL""")
def _(t):
    tool = F.expr("case event_type when 'view' then 'mcp__knowledge__add_soft_link' when 'click' then 'mcp__knowledge__update_node_metadata' when 'error' then 'mcp__x__y' else 'bash' end")
    keys = F.when(F.col("value") > 10, F.array(F.lit("a"), F.lit("r_last_evaluated_at"))).otherwise(F.array(F.lit("a")))
    return t.events.select("event_type", scalars.action_type(tool, keys).alias("action")).groupBy("event_type", "action").agg(F.count("*").alias("n"))
