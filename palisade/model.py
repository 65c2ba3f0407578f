"""Data model of the property graph: vocabularies, schemas and the ``Graph`` pair.

A graph is two DataFrames.  ``metadata`` is a *struct* holding only the keys a
graph really uses: a struct is pruned field by field down to the Parquet scan
and its predicates are pushed down, neither of which an opaque bag allows.  A
NULL field means "key absent".  Keys outside the vocabulary live in the
optional ``extra`` map (JSON text per key).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: node vocabulary -------------------------------------------
NODE_TYPES = """
codebase file class function package_manifest dependency
database schema table column rds_instance
aws_account ecs_cluster ecs_service ecs_task_definition
s3_bucket s3_prefix s3_partition s3_object image_repository image
dns_record load_balancer api_gateway backend_group
security_group nacl vpc
iam_role iam_user iam_policy identity sso_group sso_user aws:permission_set
person group application
db_role unknown
""".split()

# --- fixed values: edge vocabulary -------------------------------------------
EDGE_TYPES = """
contains hosts calls instantiates depends_on builds executes reads writes models
references soft_reference allows_traffic_to assumes attaches member_of
protected_by resolves_to routes_to
okta:assigned_to okta:maps_to okta:part_of okta:pushes_to
sso:assigned_to unknown
""".split()

# --- fixed values: metadata keys whose value is not a plain string -----------
_RULE = "array<struct<protocol:string,from_port:int,to_port:int,cidr:string,sg_id:string,type:string>>"
TYPED_NODE_KEYS = {
    "port": "bigint",
    "nullable": "boolean",
    "ordinal_position": "bigint",
    "file_count": "bigint",
    "size_bytes": "bigint",
    "start_line": "bigint",
    "end_line": "bigint",
    "is_method": "boolean",
    "repo_count": "bigint",
    "private": "boolean",
    "archived": "boolean",
    "aws_s3_client": "boolean",
    "role_login": "boolean",
    "role_superuser": "boolean",
    "object_count": "bigint",
    "image_size_bytes": "bigint",
    "rds_port": "bigint",
    "rds_publicly_accessible": "boolean",
    "rds_encryption_enabled": "boolean",
    "rds_storage_encrypted": "boolean",
    "rds_multi_az": "boolean",
    "ecs_task_revision": "bigint",
    "iam_mfa_enabled": "boolean",
    "dns_zone_private": "boolean",
    "dns_ttl": "bigint",
    "bg_port": "bigint",
    "ecs_public_ip": "boolean",
    "base_classes": "array<string>",
    "sample_keys": "array<string>",
    "ecs_container_images": "array<string>",
    "ecs_target_group_arns": "array<string>",
    "dns_values": "array<string>",
    "api_gw_custom_domains": "array<string>",
    "api_gw_integration_uris": "array<string>",
    "sg_rules_ingress": _RULE,
    "sg_rules_egress": _RULE,
    "nacl_rules": "array<struct<rule_number:int,protocol:string,rule_action:string,egress:boolean,cidr:string>>",
    "lb_listeners": "array<struct<port:int,protocol:string,default_actions:array<string>>>",
    "iam_access_keys": "array<struct<id:string,status:string,created:string>>",
    "iam_trust_policy": "variant",
    "iam_policy_document": "variant",
}

# --- fixed values: metadata keys holding plain strings -----------------------
STRING_NODE_KEYS = """
database_name host schema_name table_name table_type column_name data_type
repo_name file_path language class_name function_name receiver_type
org_name full_name default_branch clone_url scanned_commit github_org repo_url
orm_table orm_framework orm_operations orm_operation_type orm_models
http_method route_path full_route_path api_framework router_variable auth_scheme auth_scheme_var
aws_s3_operations aws_s3_operation_type
io_direction io_type cve_ids data_sensitivity role_name
package_manager manifest_file package_name package_version package_ecosystem
arn account_id region bucket_name path_pattern partition_type
repository_name repository_uri image_digest image_tags image_pushed_at oci_source oci_revision
dockerfile_base_images dockerfile_entrypoint dockerfile_cmd dockerfile_workdir dockerfile_copy_targets
rds_engine rds_endpoint rds_instance_id
ecs_cluster_name ecs_service_name ecs_task_definition ecs_task_family ecs_task_role_arn ecs_execution_role_arn
vpc_id vpc_cidr sg_id sg_name nacl_id
iam_user_name iam_last_activity iam_policy_name iam_policy_arn
sso_group_id sso_group_name sso_user_id sso_user_name sso_user_email sso_user_external_id
permission_set_name permission_set_arn permission_set_instance_arn permission_set_description
permission_set_session_duration
person_okta_id person_email person_login person_status person_display_name
group_okta_id group_name group_description
app_okta_id app_name app_label app_sign_on_mode app_status
dns_record_name dns_record_type dns_zone_name dns_zone_id
lb_type lb_scheme lb_dns_name lb_state
bg_name bg_protocol bg_target_type bg_health_check bg_backend_type
api_gw_stage api_gw_endpoint_type api_gw_auth_type
""".split()

NODE_KEYS: dict[str, str] = {k: "string" for k in STRING_NODE_KEYS} | TYPED_NODE_KEYS

# --- fixed values: edge metadata keys ----------------------------------------
EDGE_KEYS: dict[str, str] = {
    k: "string"
    for k in """
constraint_name detection_method orm_framework orm_class table_name referenced_model call_type
import_name privilege assumed_via sg_rule_protocol sg_rule_port_range sg_rule_direction
listener_protocol match_key match_value account_id permission_set_arn via_group
insecure_trust_policy saml_provider_arn note
""".split()
} | {
    "ordinal_position": "bigint",
    "confidence": "double",
    "listener_port": "bigint",
    "is_grantable": "boolean",
    "trust_policy_condition": "variant",
    "privileges": "array<string>",
}

# --- fixed values: which name suffix an edge id is built from ----------------
# Most types use the type itself or its upper-case form; the rest are listed.
_UPPER_SUFFIX = (
    "allows_traffic_to assumes attaches contains depends_on hosts member_of protected_by"
).split()
EDGE_ID_SUFFIX: dict[str, str] = {t: t.upper() for t in _UPPER_SUFFIX} | {
    "calls": "CODE_TO_CODE",
    "sso:assigned_to": "SSO_ASSIGNED_TO",
}

# Edge types that join code to data, used by most code/data questions.
CODE_TO_DATA = ("reads", "writes", "models")

# --- fixed values: legal edges per node type ---------------------------------
# node type | allowed outgoing | allowed incoming
_LEGAL = """
api_gateway | routes_to | resolves_to contains
aws:permission_set | assumes | contains sso:assigned_to
sso_user | assumes member_of sso:assigned_to | contains okta:maps_to
aws_account | contains | contains
backend_group | routes_to | routes_to contains
s3_bucket | contains |
class | contains models | contains calls instantiates
codebase | contains |
column | references soft_reference | contains references soft_reference
database | contains | hosts
dependency | contains depends_on | contains depends_on
dns_record | resolves_to | contains
ecs_cluster | contains | contains
ecs_service | assumes references protected_by | contains routes_to
ecs_task_definition | assumes references | references
file | builds contains depends_on executes | contains executes
function | calls instantiates reads writes | contains calls
iam_policy | attaches |
iam_role | | assumes attaches
iam_user | assumes | attaches member_of
identity | reads writes |
image | | contains
image_repository | contains | builds
load_balancer | routes_to protected_by | resolves_to contains
nacl | | contains
s3_prefix | contains | contains reads writes
application | | contains okta:assigned_to okta:pushes_to
group | okta:assigned_to okta:pushes_to | contains okta:part_of
person | okta:part_of okta:assigned_to okta:maps_to | contains
rds_instance | hosts protected_by | contains
schema | contains | contains
security_group | allows_traffic_to | contains protected_by allows_traffic_to
sso_group | assumes member_of sso:assigned_to | contains member_of
table | contains | contains reads writes models
vpc | contains | contains
"""


def legal_edges() -> dict[str, tuple[frozenset[str], frozenset[str]]]:
    """``node_type -> (outgoing, incoming)`` edge types a node admits."""
    table = {}
    for line in _LEGAL.strip().splitlines():
        name, out, inc = (part.strip() for part in line.split("|"))
        table[name] = (frozenset(out.split()), frozenset(inc.split()))
    return table


NODE_COLUMNS = ["urn", "organization_id", "parent_urn", "node_type", "metadata", "ord"]
EDGE_COLUMNS = ["uuid", "organization_id", "from_urn", "to_urn", "edge_type", "metadata", "ord"]

SOFT_LINK_SCHEMA = T.StructType(
    [
        T.StructField(n, T.DoubleType() if n == "confidence" else T.StringType())
        for n in (
            "id from_urn to_urn edge_type detection_method confidence confidence_level note created_at"
        ).split()
    ]
)

DEFAULT_ORG = "00000000-0000-0000-0000-000000000001"


class DuplicateNodeError(RuntimeError):
    """Two nodes share one URN: a configuration or logic error in the inputs."""


@dataclass(frozen=True)
class Graph:
    """An immutable pair of DataFrames plus the user's own links."""

    nodes: DataFrame
    edges: DataFrame
    soft_links: DataFrame | None = None

    @property
    def spark(self):
        return self.nodes.sparkSession

    def of_type(self, *types: str) -> DataFrame:
        return self.nodes.filter(F.col("node_type").isin(*types))

    def edges_of(self, *types: str) -> DataFrame:
        return self.edges.filter(F.col("edge_type").isin(*types))

    def edge_types(self) -> list[str] | None:
        """Types of edges there may be, if that is known without reading any."""
        return None

    def version(self) -> str | None:
        """What the graph was computed from, where equal text means equal inputs; None if that is not known."""
        return None

    def with_nodes(self, nodes: DataFrame) -> Graph:
        return replace(self, nodes=nodes)

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges)

    def merge(self, *others: Graph) -> Graph:
        """Concatenate node and edge lists; nothing is deduplicated here."""
        graphs = (self, *others)
        return replace(
            self,
            nodes=union_all([g.nodes for g in graphs]),
            edges=union_all([g.edges for g in graphs]),
        )

    def duplicate_urns(self) -> DataFrame:
        """URNs carried by more than one node row."""
        return self.nodes.groupBy("urn").agg(F.count("*").alias("n")).filter("n > 1")

    def validate(self) -> Graph:
        """Raise if any URN is duplicated; one aggregate, at most one row fetched."""
        bad = self.duplicate_urns().orderBy("urn").limit(1).collect()
        if bad:
            raise DuplicateNodeError(f"duplicate node URN: {bad[0]['urn']} ({bad[0]['n']} rows)")
        return self

    def vertices(self) -> DataFrame:
        """Every URN of the graph, dangling edge endpoints included."""
        ends = self.edges.select(F.explode(F.array("from_urn", "to_urn")).alias("urn"))
        return self.nodes.select("urn").union(ends).distinct()


class PartGraph(Graph):
    """A graph held as one frame per node and edge type.

    Asking for a type touches only its frames, so plans stay as small as the
    question; asking for all nodes or edges unites the frames.
    """

    def __init__(self, node_parts: list[tuple[str, DataFrame]], edge_parts: list[tuple[str, DataFrame]], soft_links: DataFrame | None = None):
        for name, value in (("node_parts", node_parts), ("edge_parts", edge_parts), ("soft_links", soft_links)):
            object.__setattr__(self, name, value)

    @cached_property
    def nodes(self) -> DataFrame:  # type: ignore[override]
        return union_all([frame for _, frame in self.node_parts])

    @cached_property
    def edges(self) -> DataFrame:  # type: ignore[override]
        return union_all([frame for _, frame in self.edge_parts])

    def of_type(self, *types: str) -> DataFrame:
        parts = [frame for kind, frame in self.node_parts if kind in types]
        return union_all(parts) if parts else self.node_parts[0][1].limit(0)

    def edges_of(self, *types: str) -> DataFrame:
        parts = [frame for kind, frame in self.edge_parts if kind in types]
        return union_all(parts) if parts else self.edge_parts[0][1].limit(0)

    def edge_types(self) -> list[str]:
        return sorted({kind for kind, _ in self.edge_parts})

    def with_nodes(self, nodes: DataFrame) -> Graph:
        return Graph(nodes, self.edges, self.soft_links)

    def with_edges(self, edges: DataFrame) -> Graph:
        return Graph(self.nodes, edges, self.soft_links)

    def with_edge_parts(self, *parts: tuple[str, DataFrame]) -> PartGraph:
        return PartGraph(self.node_parts, [*self.edge_parts, *parts], self.soft_links)

    def merge(self, *others: Graph) -> Graph:
        if all(isinstance(o, PartGraph) for o in others):
            graphs = (self, *others)
            return PartGraph([p for g in graphs for p in g.node_parts], [p for g in graphs for p in g.edge_parts], self.soft_links)
        return Graph(self.nodes, self.edges, self.soft_links).merge(*others)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name, widening ``metadata`` structs to the keys any side has.

    Every frame is aligned to the merged struct in one flat projection; letting
    pairwise unions merge nested structs would nest their expressions instead.
    """
    if len(frames) == 1:
        return frames[0]
    fields: dict[str, T.DataType] = {}
    for frame in frames:
        for field in _metadata_fields(frame):
            fields.setdefault(field.name, field.dataType)
    aligned = [_align(frame, fields) for frame in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)


def _metadata_fields(frame: DataFrame) -> list[T.StructField]:
    if "metadata" not in frame.columns:
        return []
    return frame.schema["metadata"].dataType.fields


def _align(frame: DataFrame, fields: dict[str, T.DataType]) -> DataFrame:
    own = {f.name for f in _metadata_fields(frame)}
    if not fields or "metadata" not in frame.columns or own == set(fields) and [
        f.name for f in _metadata_fields(frame)
    ] == list(fields):
        return frame
    parts = ", ".join(
        f"metadata.`{k}` as `{k}`" if k in own else f"cast(null as {kind.simpleString()}) as `{k}`"
        for k, kind in fields.items()
    )
    return frame.withColumn("metadata", F.expr(f"struct({parts})"))
