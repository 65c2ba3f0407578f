"""Registered queries over the derived cloud estate: loaders (S7, S8) and stitchers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions import meta
from palisade.model import Graph, union_all
from palisade.operators import security
from palisade.operators.search import settle_edges
from palisade.operators.stitch import containers, identity, network
from palisade.plans import estate
from palisade.plans.tables import Tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

A = "urn:arn:aws"
LB = f"'{A}:elasticloadbalancing:us-east-1:123456789012:loadbalancer/lb-'"
TG = f"'{A}:elasticloadbalancing:us-east-1:123456789012:targetgroup/lb-'"
SG = f"'{A}:ec2:us-east-1:123456789012:security-group/sg-'"
ROLE = f"'{A}:iam::123456789012:role/'"
DNS = f"'{A}:route53:::hostedzone/Z' || c_nationkey || '/recordset/app' || c_custkey || '.example/' || CASE c_mktsegment WHEN 'BUILDING' THEN 'A' WHEN 'MACHINERY' THEN 'CNAME' ELSE 'TXT' END"
TASK = f"'{A}:ecs:us-east-1:123456789012:task-definition/' || lower(c_mktsegment) || ':' || c_nationkey"
SVC = f"'{A}:ecs:us-east-1:123456789012:service/c' || n_regionkey || '/svc-' || c_custkey"
ROOT = "'urn:aws:account:123456789012:us-east-1:root'"
HOMES = "customer JOIN nation ON n_nationkey = c_nationkey"


def query(name: str, sql: str | None = None, services: list[str] | None = None, build=None):
    def wrap(fn):
        def run(spark, folder) -> DataFrame:
            return fn(build(spark, folder) if build else estate.aws_graph(spark, folder, services))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def _nodes(graph: Graph, *keys: str, kind: str | None = None) -> DataFrame:
    nodes = graph.of_type(kind) if kind else graph.nodes.filter("node_type <> 'aws_account'")
    return nodes.select("urn", "parent_urn", *[meta.get(nodes, k).alias(k) for k in keys])


def _edges(edges: DataFrame, *keys: str) -> DataFrame:
    return edges.select("from_urn", "to_urn", "edge_type", *[meta.get(edges, k).alias(k) for k in keys])


# --- loaders -----------------------------------------------------------------------


@query("s7a_apigateway", f"""
WITH uris AS (SELECT page_id, string_agg('arn:aws:elasticloadbalancing:us-east-1:123456789012:listener/app/lb-' || s_suppkey || '/' || md5(s_name)[1:16] || '/f00d', ',') AS u
  FROM pages JOIN supplier ON s_suppkey = length(url) GROUP BY 1)
SELECT '{A}:apigateway:us-east-1::/apis/api' || page_id AS urn, {ROOT} AS parent_urn, CASE WHEN url LIKE 'https%' THEN 'http' ELSE 'websocket' END AS lb_type,
  'internet-facing' AS lb_scheme, url AS lb_dns_name, CASE WHEN url LIKE 'https%' THEN 'HTTP' ELSE 'WEBSOCKET' END AS api_gw_endpoint_type, u AS uris
FROM pages LEFT JOIN uris USING (page_id)
UNION ALL SELECT '{A}:apigateway:us-east-1::/apis/rest' || n_nationkey, {ROOT}, 'rest', CASE WHEN n_regionkey = 4 THEN 'internal' ELSE 'internet-facing' END,
  'rest' || n_nationkey || '.execute-api.us-east-1.amazonaws.com', CASE WHEN n_regionkey = 4 THEN 'PRIVATE' ELSE 'REGIONAL' END, NULL FROM nation""", ["apigateway"])
def _(g):
    n = _nodes(g, "lb_type", "lb_scheme", "lb_dns_name", "api_gw_endpoint_type", "api_gw_integration_uris")
    return n.withColumn("uris", F.array_join("api_gw_integration_uris", ",")).drop("api_gw_integration_uris")


@query("s7b_ecr_images", f"""
SELECT '{A}:ecr:us-east-1:123456789012:repository/' || lower(c_mktsegment) || '/image/sha256:' || c_custkey AS urn,
  '{A}:ecr:us-east-1:123456789012:repository/' || lower(c_mktsegment) AS parent_urn, 'latest,v' || c_nationkey AS image_tags,
  'https://git.example.com/n' || c_nationkey AS oci_source FROM customer WHERE c_acctbal > 0""", ["ecr"])
def _(g):
    return _nodes(g, "image_tags", "oci_source", kind="image")


@query("s7c_ecs_edges", f"""
WITH svc AS (SELECT *, {SVC} AS urn FROM {HOMES}), td AS (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer)
SELECT '{A}:ecs:us-east-1:123456789012:cluster/c' || n_regionkey AS from_urn, urn AS to_urn, 'contains' AS edge_type, CAST(NULL AS VARCHAR) AS assumed_via FROM svc
UNION ALL SELECT urn, {SG} || c_nationkey, 'protected_by', NULL FROM svc
UNION ALL SELECT urn, '{A}:ec2:us-east-1:123456789012:security-group/sg-gone', 'protected_by', NULL FROM svc
UNION ALL SELECT urn, {TASK}, 'references', NULL FROM svc
UNION ALL SELECT {TASK}, {ROLE} || 'cust-' || c_nationkey, 'assumes', 'taskRoleArn' FROM td
UNION ALL SELECT {TASK}, {ROLE} || 'exec', 'assumes', 'executionRoleArn' FROM td WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT {ROOT}, '{A}:ecs:us-east-1:123456789012:cluster/c' || r_regionkey, 'contains', NULL FROM region""", ["ecs"])
def _(g):
    return _edges(g.edges, "assumed_via")


@query("s7d_elbv2", f"""
SELECT {LB} || s_suppkey AS from_urn, {TG} || s_suppkey || '/tg-' || s_suppkey AS to_urn, 'routes_to' AS edge_type, CASE WHEN s_suppkey % 2 = 0 THEN 443 ELSE 80 END AS listener_port, CASE WHEN s_suppkey % 2 = 0 THEN 'HTTPS' ELSE 'HTTP' END AS listener_protocol FROM supplier
UNION ALL SELECT {LB} || s_suppkey, {SG} || s_nationkey, 'protected_by', NULL, NULL FROM supplier
UNION ALL SELECT {ROOT}, {LB} || s_suppkey, 'contains', NULL, NULL FROM supplier
UNION ALL SELECT {ROOT}, {TG} || s_suppkey || '/tg-' || s_suppkey, 'contains', NULL, NULL FROM supplier""", ["elbv2"])
def _(g):
    return _edges(g.edges, "listener_port", "listener_protocol")


@query("s7e_iam", f"""
SELECT {ROLE} || 'cust-' || c_custkey AS to_urn, CASE WHEN c_mktsegment = 'BUILDING' THEN '{A}:iam::aws:policy/p-' ELSE '{A}:iam::123456789012:policy/p-' END || lower(c_mktsegment) AS from_urn,
  'attaches' AS edge_type, 'attached' AS privilege FROM customer""", ["iam"])
def _(g):
    return _edges(g.edges_of("attaches"), "privilege")


@query("s7e_iam_users", f"""
SELECT '{A}:iam::123456789012:user/' || s_name AS urn, {ROOT} AS parent_urn, s_nationkey < 10 AS iam_mfa_enabled,
  CASE WHEN s_acctbal > 0 THEN CASE WHEN s_nationkey < 5 THEN 'Inactive' ELSE 'Active' END END AS key_status FROM supplier""", ["iam"])
def _(g):
    n = _nodes(g, "iam_mfa_enabled", "iam_access_keys", kind="iam_user")
    return n.withColumn("key_status", F.array_join(F.col("iam_access_keys")["status"], ",")).drop("iam_access_keys")


@query("s7f_rds", f"""
SELECT '{A}:rds:us-east-1:123456789012:db:db-' || s_suppkey AS urn, {ROOT} AS parent_urn, 'db' || s_suppkey || '.rds.example' AS rds_endpoint, 5432 AS rds_port,
  s_acctbal < 0 AS rds_publicly_accessible FROM supplier""", ["rds"])
def _(g):
    return _nodes(g, "rds_endpoint", "rds_port", "rds_publicly_accessible")


_RECORDS = f"""
WITH records AS (SELECT *, {DNS} AS urn, n_regionkey = 4 AS private,
  CASE c_mktsegment WHEN 'BUILDING' THEN ['LB-' || c_nationkey || '.elb.amazonaws.com']
    WHEN 'MACHINERY' THEN ['https://rest' || c_nationkey || '.execute-api.us-east-1.amazonaws.com/', 'LB-' || c_custkey || '.elb.amazonaws.com'] ELSE [] END AS vals
  FROM {HOMES} WHERE c_mktsegment <> 'HOUSEHOLD')
"""


@query("s7g_route53", _RECORDS + f"SELECT urn, {ROOT} AS parent_urn, 'app' || c_custkey || '.example' AS dns_record_name, private AS dns_zone_private, array_to_string(vals, ',') AS dns_values FROM records", ["route53"])
def _(g):
    n = _nodes(g, "dns_record_name", "dns_zone_private", "dns_values")
    return n.withColumn("dns_values", F.array_join("dns_values", ","))


@query("s7h_s3", f"""
SELECT DISTINCT '{A}:s3:::bucket-' || source || '-' || lang AS urn, {ROOT} AS parent_urn, 'bucket-' || source || '-' || lang AS bucket_name FROM documents WHERE lang <> 'de'""", ["s3"])
def _(g):
    return _nodes(g, "bucket_name")


_SSO = f"""
WITH member AS (SELECT DISTINCT event_type, user_id FROM events WHERE value > 20)
, granted AS (
  SELECT DISTINCT '{A}:identitystore::123456789012:user/u-' || p_size AS who, lower(p_type) AS ps, CASE WHEN p_size > 10 THEN '123456789012' ELSE '999999999999' END AS account
    FROM part WHERE p_size IN (SELECT user_id FROM events)
  UNION ALL SELECT DISTINCT '{A}:identitystore::123456789012:group/g-' || event_type, unnest(['economy', 'promo']), '123456789012' FROM (SELECT DISTINCT event_type FROM events) e)
"""


@query("s7i_sso_edges", _SSO + f"""
SELECT '{A}:identitystore::123456789012:user/u-' || user_id AS from_urn, '{A}:identitystore::123456789012:group/g-' || event_type AS to_urn, 'member_of' AS edge_type, CAST(NULL AS VARCHAR) AS account_id FROM member
UNION ALL SELECT who, '{A}:sso::123456789012:permission-set/ps-' || ps, 'sso:assigned_to', account FROM granted""", ["sso"])
def _(g):
    return _edges(g.edges_of("member_of", "sso:assigned_to"), "account_id")


@query("s7i_sso_users", f"""
SELECT '{A}:identitystore::123456789012:user/u-' || user_id AS urn, {ROOT} AS parent_urn, 'User' || user_id || '@Example.com' AS sso_user_email,
  CASE WHEN max(value) > 60 THEN 'okta' || user_id END AS sso_user_external_id FROM events GROUP BY user_id""", ["sso"])
def _(g):
    return _nodes(g, "sso_user_email", "sso_user_external_id", kind="sso_user")


@query("s7j_vpc_edges", f"""
SELECT '{A}:ec2:us-east-1:123456789012:vpc/vpc-' || n_regionkey AS from_urn, {SG} || n_nationkey AS to_urn, 'contains' AS edge_type, CAST(NULL AS VARCHAR) AS sg_rule_port_range FROM nation
UNION ALL SELECT '{A}:ec2:us-east-1:123456789012:vpc/vpc-' || r_regionkey, '{A}:ec2:us-east-1:123456789012:network-acl/acl-' || r_regionkey, 'contains', NULL FROM region
UNION ALL SELECT {SG} || (n_nationkey + 1), {SG} || n_nationkey, 'allows_traffic_to', CASE WHEN n_regionkey = 1 THEN '443-8443' ELSE '443' END FROM nation
UNION ALL SELECT {ROOT}, '{A}:ec2:us-east-1:123456789012:vpc/vpc-' || r_regionkey, 'contains', NULL FROM region""", ["vpc"])
def _(g):
    return _edges(g.edges, "sg_rule_port_range")


@query("s7j_security_group_rules", f"""
SELECT {SG} || n_nationkey AS urn, x.kind AS rule_type, CASE x.kind WHEN 'ipv4' THEN CASE WHEN n_regionkey = 0 THEN '0.0.0.0/0' ELSE '10.0.0.0/8' END WHEN 'ipv6' THEN '::/0' END AS cidr,
  CASE WHEN x.kind = 'sg_ref' THEN 'sg-' || (n_nationkey + 1) END AS sg_id, CASE WHEN n_regionkey = 1 THEN 8443 ELSE 443 END AS to_port
FROM nation, (VALUES ('ipv4'), ('ipv6'), ('sg_ref')) x(kind)""", ["vpc"])
def _(g):
    n = g.of_type("security_group")
    return n.select("urn", F.explode(meta.get(n, "sg_rules_ingress")).alias("r")).select("urn", F.col("r.type").alias("rule_type"), "r.cidr", "r.sg_id", "r.to_port")


_OKTA = """
WITH people AS (SELECT user_id, CASE WHEN max(value) > 50 THEN 'okta' ELSE 'x' END || user_id AS id FROM events GROUP BY user_id)
"""
_OURN = "'urn:okta:idp:example.okta.com::"


@query("s8_okta_edges", _OKTA + f"""
SELECT DISTINCT {_OURN}user/' || id AS from_urn, {_OURN}group/grp-' || event_type AS to_urn, 'okta:part_of' AS edge_type FROM events JOIN people USING (user_id)
UNION ALL SELECT {_OURN}user/okta' || doc_id, {_OURN}app/app-' || lang, 'okta:assigned_to' FROM documents WHERE 'okta' || doc_id IN (SELECT id FROM people)
UNION ALL SELECT DISTINCT {_OURN}group/grp-' || event_type, {_OURN}app/app-' || CASE WHEN event_type IN ('view', 'click') THEN 'en' ELSE 'fr' END, 'okta:assigned_to' FROM events
UNION ALL SELECT DISTINCT {_OURN}group/grp-' || event_type, {_OURN}app/app-de', 'okta:pushes_to' FROM events WHERE event_type <> 'view'""", build=estate.okta_graph)
def _(g):
    return _edges(g.edges)


@query("s8_okta_people", _OKTA + f"""
SELECT {_OURN}user/' || id AS urn, CAST(NULL AS VARCHAR) AS parent_urn, 'user' || user_id || '@example.com' AS person_email, 'User ' || user_id AS person_display_name FROM people""", build=estate.okta_graph)
def _(g):
    return _nodes(g, "person_email", "person_display_name", kind="person")


# --- stitchers ---------------------------------------------------------------------


def _rds_and_databases(spark, folder):
    return estate.with_databases(estate.aws_graph(spark, folder, ["rds"]), Tables(spark, folder))


@query("j5_rds_to_database", f"""
SELECT '{A}:rds:us-east-1:123456789012:db:db-' || s_suppkey AS from_urn, 'urn:onprem:postgres:db' || s_suppkey || '.rds.example:5432:app' AS to_urn, 'hosts' AS edge_type
FROM supplier WHERE s_acctbal > 0""", build=_rds_and_databases)
def _(g):
    return _edges(network.rds_to_database(g))


@query("j6_ecs_task_to_repository", f"""
SELECT DISTINCT {TASK} AS from_urn, '{A}:ecr:us-east-1:123456789012:repository/' || lower(c_mktsegment) AS to_urn, 'references' AS edge_type FROM customer""", ["ecs", "ecr"])
def _(g):
    return _edges(containers.ecs_task_to_repository(g))


_DOORS = _RECORDS + f"""
, doors AS (SELECT 'lb-' || s_suppkey || '.elb.amazonaws.com' AS name, {LB} || s_suppkey AS door FROM supplier
  UNION ALL SELECT 'rest' || n_nationkey || '.execute-api.us-east-1.amazonaws.com', '{A}:apigateway:us-east-1::/apis/rest' || n_nationkey FROM nation)
, resolved AS (SELECT urn, private, door FROM (SELECT urn, private, unnest(vals) AS v FROM records) r
  JOIN doors ON name = rtrim(regexp_replace(lower(trim(v)), '^https?://', ''), './'))
"""


@query("j7_dns_to_front_door", _DOORS + "SELECT urn AS from_urn, door AS to_urn, 'resolves_to' AS edge_type FROM resolved", ["route53", "elbv2", "apigateway"])
def _(g):
    return _edges(network.dns_to_front_door(g))


@query("j8_gateway_to_balancer", f"""
WITH uris AS (SELECT page_id, 'arn:aws:elasticloadbalancing:us-east-1:123456789012:listener/app/lb-' || s_suppkey || '/' || md5(s_name)[1:16] || '/f00d' AS uri FROM pages JOIN supplier ON s_suppkey = length(url))
SELECT '{A}:apigateway:us-east-1::/apis/api' || page_id AS from_urn, {LB} || s_suppkey AS to_urn, 'routes_to' AS edge_type
FROM uris JOIN supplier ON contains(uri, 'listener/app/lb-' || s_suppkey || '/' || md5(s_name)[1:16])""", ["apigateway", "elbv2"])
def _(g):
    return _edges(network.gateway_to_balancer(g))


_POOLS = f"""
WITH svc AS (SELECT {SVC} AS urn, unnest([c_nationkey, c_custkey]) AS k, c_mktsegment, c_nationkey FROM {HOMES})
, pools AS (SELECT {TG} || s_suppkey || '/tg-' || s_suppkey AS pool, urn, s_suppkey, c_mktsegment, c_nationkey FROM svc JOIN supplier ON s_suppkey = k)
"""


@query("j9_pool_to_service", _POOLS + "SELECT pool AS from_urn, urn AS to_urn, 'routes_to' AS edge_type FROM pools", ["elbv2", "ecs"])
def _(g):
    return _edges(network.pool_to_service(g))


def _people(spark, folder):
    return estate.aws_graph(spark, folder, ["sso"]).merge(estate.okta_graph(spark, folder))


@query("j10_person_to_sso_user", _OKTA + f"""
, sso AS (SELECT user_id, CASE WHEN max(value) > 60 THEN 'okta' || user_id END AS ext FROM events GROUP BY user_id)
SELECT {_OURN}user/' || id AS from_urn, '{A}:identitystore::123456789012:user/u-' || user_id AS to_urn, 'okta:maps_to' AS edge_type,
  CASE WHEN ext = id THEN 'externalId' ELSE 'email' END AS match_key, CASE WHEN ext = id THEN 1.0 ELSE 0.85 END::DOUBLE AS confidence FROM people JOIN sso USING (user_id)""", build=_people)
def _(g):
    return _edges(identity.person_to_sso_user(g), "match_key", "confidence")


@query("j11_sso_to_iam", _SSO + f"""
, role AS (SELECT DISTINCT lower(p_type) AS ps, {ROLE} || 'AWSReservedSSO_' || upper(p_type[1:1]) || lower(p_type[2:]) || 'Access_' || md5(p_type)[1:16] AS role FROM part)
, direct AS (SELECT who, role FROM granted JOIN role USING (ps) WHERE account = '123456789012')
SELECT '{A}:sso::123456789012:permission-set/ps-' || ps AS from_urn, role AS to_urn, 'assumes' AS edge_type, 'iam:permission_set_role' AS assumed_via, CAST(NULL AS VARCHAR) AS via_group FROM role
UNION ALL SELECT who, role, 'assumes', 'sso:permission_set', NULL FROM direct
UNION ALL SELECT '{A}:identitystore::123456789012:user/u-' || user_id, role, 'assumes', 'sso:permission_set', who FROM direct JOIN member ON who = '{A}:identitystore::123456789012:group/g-' || event_type""", ["sso", "iam"])
def _(g):
    return _edges(identity.sso_to_iam(g), "assumed_via", "via_group")


@query("j11_settled", _SSO + f"""
, role AS (SELECT DISTINCT lower(p_type) AS ps, {ROLE} || 'AWSReservedSSO_' || upper(p_type[1:1]) || lower(p_type[2:]) || 'Access_' || md5(p_type)[1:16] AS role FROM part)
, direct AS (SELECT who, role FROM granted JOIN role USING (ps) WHERE account = '123456789012')
, via AS (SELECT '{A}:identitystore::123456789012:user/u-' || user_id AS who, role, arg_max(who, 1000 - ascii(event_type)) AS via_group
  FROM direct JOIN member ON who = '{A}:identitystore::123456789012:group/g-' || event_type GROUP BY 1, 2)
SELECT '{A}:sso::123456789012:permission-set/ps-' || ps AS from_urn, role AS to_urn, 'assumes' AS edge_type, 'iam:permission_set_role' AS assumed_via, CAST(NULL AS VARCHAR) AS via_group FROM role
UNION ALL SELECT who, role, 'assumes', 'sso:permission_set', via_group FROM (SELECT DISTINCT who, role FROM direct UNION SELECT who, role FROM via) LEFT JOIN via USING (who, role)""", ["sso", "iam"])
def _(g):
    """As a store keeps them: of several edges between two nodes the last, through the group that was assigned last."""
    return _edges(settle_edges(identity.sso_to_iam(g)), "assumed_via", "via_group")


@query("j12_role_trust", f"""
WITH c AS (SELECT *, {ROLE} || 'cust-' || c_custkey AS role, c_acctbal < 0 AS conditional FROM customer WHERE c_acctbal <= 9000)
SELECT 'urn:aws:iam:wildcard::*' AS from_urn, role AS to_urn, 'assumes' AS edge_type, 'iam:trust_policy_wildcard' AS assumed_via, 'wildcard' AS insecure_trust_policy, conditional FROM c WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
UNION ALL SELECT 'urn:aws:iam:' || lpad(c_nationkey::VARCHAR, 12, '0') || '::root', role, 'assumes', 'iam:trust_policy_account_root', 'account_root', conditional FROM c WHERE c_mktsegment = 'MACHINERY'
UNION ALL SELECT {ROLE} || 'cust-' || c_nationkey, role, 'assumes', 'iam:trust_policy', NULL, conditional FROM c WHERE c_mktsegment = 'AUTOMOBILE' AND c_nationkey <> c_custkey
UNION ALL SELECT 'urn:aws:iam:123456789012::saml-provider/Corp', role, 'assumes', 'iam:trust_policy_saml', NULL, conditional FROM c WHERE c_mktsegment = 'FURNITURE'
UNION ALL SELECT 'urn:aws:iam:federated::accounts.example.com', role, 'assumes', 'iam:trust_policy_federated', NULL, conditional FROM c WHERE c_mktsegment = 'FURNITURE'""", ["iam"])
def _(g):
    found = _edges(identity.role_trust(g), "assumed_via", "insecure_trust_policy", "trust_policy_condition")
    return found.withColumn("conditional", F.col("trust_policy_condition").isNotNull()).drop("trust_policy_condition")


def _placeholders(spark, folder):
    g = estate.aws_graph(spark, folder, ["vpc"])
    t = Tables(spark, folder)
    held = t.supplier.selectExpr(
        "concat('id-', s_suppkey) as uuid", "'o' as organization_id", "concat('urn:aws:ecs:1:r:svc/', s_suppkey) as from_urn",
        "concat('urn:aws:ec2:1:unknown/sg/sg-', s_suppkey)  as to_urn", "'protected_by' as edge_type", "struct('x' as detection_method) as metadata", "s_suppkey as ord",
    ).withColumn("to_urn", F.replace("to_urn", F.lit(":1:unknown"), F.lit(":1:r:unknown")))
    return Graph(g.nodes, union_all([g.edges, held]))


@query("j13_resolve_security_groups", f"""
SELECT 'urn:aws:ecs:1:r:svc/' || s_suppkey AS from_urn, CASE WHEN s_suppkey < 25 THEN {SG} || s_suppkey ELSE 'urn:aws:ec2:1:r:unknown/sg/sg-' || s_suppkey END AS to_urn, s_suppkey < 25 AS renamed FROM supplier""", build=_placeholders)
def _(g):
    out = network.resolve_security_groups(g).edges_of("protected_by")
    return out.select("from_urn", "to_urn", (~F.col("uuid").startswith("id-")).alias("renamed"))


def _surface(spark, folder):
    g = estate.aws_graph(spark, folder, ["route53", "elbv2", "apigateway", "ecs", "vpc", "iam"])
    return g.with_edge_parts(("resolves_to", network.dns_to_front_door(g)), ("routes_to", network.pool_to_service(g)))


@query("g7_public_attack_surface", f"""
WITH svc AS (SELECT {SVC} AS svc_urn, unnest([c_nationkey, c_custkey]) AS k, 'svc-' || c_custkey AS svc_name, c_nationkey AS svc_nation FROM {HOMES})
, {_DOORS.strip()[5:]}
, fronts AS (SELECT {LB} || s_suppkey AS door, CASE WHEN s_acctbal > 5000 THEN 'nlb' ELSE 'alb' END AS lb_type, s_suppkey,
    n_name || CASE WHEN n_regionkey = 0 THEN ' [PUBLIC]' ELSE '' END AS groups FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_nationkey < 15
  UNION ALL SELECT '{A}:apigateway:us-east-1::/apis/rest' || n_nationkey, 'rest', NULL, NULL FROM nation WHERE n_regionkey <> 4)
, open_doors AS (SELECT DISTINCT urn, door, lb_type, groups, s_suppkey FROM resolved JOIN fronts USING (door) WHERE NOT private)
SELECT DISTINCT 'front' AS part, urn AS dns_urn, door AS lb_urn, lb_type, groups AS security_groups, NULL AS service_urn, NULL AS service, NULL AS iam_roles FROM open_doors
UNION ALL SELECT DISTINCT 'behind', NULL, door, lb_type, NULL, svc_urn, svc_name, 'cust-' || svc_nation FROM open_doors JOIN svc ON svc.k = s_suppkey""", build=_surface)
def _(g):
    return security.attack_surface_parts(g).select("part", "dns_urn", "lb_urn", "lb_type", "security_groups", "service_urn", "service", "iam_roles").distinct()


@query("s1_settled_edges", """
SELECT 'contains' AS edge_type, (SELECT count(*) FROM customer) + (SELECT count(*) FROM region) AS n
UNION ALL SELECT 'protected_by', 2 * count(*) FROM customer UNION ALL SELECT 'references', count(*) FROM customer
UNION ALL SELECT 'assumes', (SELECT count(DISTINCT (c_mktsegment, c_nationkey)) FROM customer) + (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_mktsegment = 'BUILDING')""", ["ecs"])
def _(g):
    """Every edge listed twice settles to one per (from, to, id)."""
    doubled = settle_edges(union_all([g.edges, g.edges]))
    return doubled.groupBy("edge_type").agg(F.count("*").alias("n"))
