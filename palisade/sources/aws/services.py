"""AWS services as node and edge frames (S7a-S7j).

Each function maps response items to ``(nodes, edges)``; nested lists are
exploded or transformed in place and lookups between resources are joins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.build import edge_frame, node_frame, stable_ordinal
from palisade.sources.aws.dump import PLACE, Dump

Part = tuple[str, DataFrame]
Frames = tuple[list[Part], list[Part]]


def node(df: DataFrame, kind: str, *args: str | None, **fields: str) -> Part:
    return kind, node_frame(df, kind, *args, **fields)


def edge(df: DataFrame, kind: str, *args: str, **fields: str) -> Part:
    return kind, edge_frame(df, kind, *args, **fields)


@dataclass(frozen=True)
class Account:
    id: str
    region: str

    @property
    def urn(self) -> str:
        return f"urn:aws:account:{self.id}:{self.region}:root"

    @property
    def root(self) -> str:
        return f"'{self.urn}'"

    def regional(self, service: str, *path: str) -> str:
        """SQL text of an ARN-wrapped URN with region and account."""
        return f"concat('urn:arn:aws:{service}:{self.region}:{self.id}:', {', '.join(path)})"

    def unregional(self, service: str, *path: str) -> str:
        return f"concat('urn:arn:aws:{service}::{self.id}:', {', '.join(path)})"

    def security_group(self, sg: str) -> str:
        return self.regional("ec2", "'security-group/'", sg)

    def role(self, name: str) -> str:
        return self.unregional("iam", "'role/'", name)


def apigateway(d: Dump, a: Account) -> Frames:
    """HTTP and REST APIs; a REST API is internal iff one endpoint type is PRIVATE."""
    uris = (
        d.http_integrations.filter("IntegrationUri <> ''").groupBy("ApiId")
        .agg(F.array_sort(F.collect_list("IntegrationUri")).alias("uris"))  # few per API
    )
    targets = d.domain_names.select("DomainName", F.col("DomainNameConfigurations")[0]["ApiGatewayDomainName"].alias("target"))
    domains = (
        d.api_mappings.join(targets, "DomainName").filter("DomainName <> ''")
        .selectExpr("ApiId", "explode(filter(array(nullif(target, ''), DomainName), x -> x is not null)) as domain")
        .groupBy("ApiId").agg(F.array_sort(F.collect_set("domain")).alias("domains"))
    )
    urn = lambda key: f"concat('urn:arn:aws:apigateway:{a.region}::/apis/', {key})"
    http = d.http_apis.join(uris, "ApiId", "left").join(domains, "ApiId", "left")
    protocol = "coalesce(ProtocolType, 'HTTP')"
    private = "coalesce(array_contains(endpointConfiguration.types, 'PRIVATE'), false)"
    return [
        node(
            http, "api_gateway", urn("ApiId"), a.root, stable_ordinal("ApiId"),
            lb_type=f"if({protocol} = 'HTTP', 'http', 'websocket')", lb_scheme="'internet-facing'", lb_dns_name="coalesce(ApiEndpoint, '')",
            arn="ApiId", api_gw_endpoint_type=protocol, api_gw_integration_uris="uris", api_gw_custom_domains="domains",
        ),
        node(
            d.rest_apis, "api_gateway", urn("id"), a.root, stable_ordinal("id"),
            lb_type="'rest'", lb_scheme=f"if({private}, 'internal', 'internet-facing')",
            lb_dns_name=f"concat(id, '.execute-api.{a.region}.amazonaws.com')", arn="id",
            api_gw_endpoint_type="coalesce(get(endpointConfiguration.types, 0), 'EDGE')",
        ),
    ], []


def ecr(d: Dump, a: Account) -> Frames:
    """Repositories and tagged images; OCI labels through manifest -> config."""
    repo = a.regional("ecr", "'repository/'", "repositoryName")
    image = a.regional("ecr", "'repository/'", "repositoryName", "'/image/'", "imageDigest")
    manifests = d.image_manifests.selectExpr("repositoryName", "imageId.imageDigest as imageDigest", "imageManifest as body")
    configs = manifests.selectExpr(
        "repositoryName", "imageDigest as config",
        "get_json_object(body, '$.config.Labels[\\'org.opencontainers.image.source\\']') as oci_source",
        "get_json_object(body, '$.config.Labels[\\'org.opencontainers.image.revision\\']') as oci_revision",
    )
    labels = manifests.selectExpr("repositoryName", "imageDigest", "get_json_object(body, '$.config.digest') as config").join(
        configs, ["repositoryName", "config"]
    ).drop("config")
    tagged = d.images.filter("size(imageTags) > 0").join(labels, ["repositoryName", "imageDigest"], "left")
    return [
        node(
            d.repositories, "image_repository", repo, a.root, stable_ordinal("repositoryName"),
            repository_name="repositoryName", repository_uri="repositoryUri", arn="repositoryArn", account_id=f"'{a.id}'", region=f"'{a.region}'",
        ),
        node(
            tagged, "image", image, repo, stable_ordinal("repositoryName", "imageDigest"),
            image_digest="imageDigest", image_tags="array_join(array_sort(imageTags), ',')", image_pushed_at="nullif(imagePushedAt, '')",
            image_size_bytes="imageSizeInBytes", oci_source="oci_source", oci_revision="oci_revision",
        ),
    ], [edge(tagged, "contains", repo, image, stable_ordinal("repositoryName", "imageDigest"))]


def ecs(d: Dump, a: Account) -> Frames:
    """Clusters, services and task definitions with their groups and roles."""
    name = "element_at(split(clusterArn, '/'), -1)"
    cluster = a.regional("ecs", "'cluster/'", name)
    service = a.regional("ecs", "'service/'", name, "'/'", "serviceName")
    task = a.regional("ecs", "'task-definition/'", "coalesce(family, 'unknown')", "':'", "coalesce(revision, 0)")
    services = d.services
    groups = services.selectExpr("clusterArn", "serviceName", "explode(networkConfiguration.awsvpcConfiguration.securityGroups) as sg")
    used = services.filter("taskDefinition <> ''").selectExpr("clusterArn", "serviceName", "taskDefinition as taskDefinitionArn")
    # a definition is described once per service that names it; it is one node all the same
    named = d.task_definitions.join(used.select("taskDefinitionArn"), "taskDefinitionArn", "left_semi")
    runs = used.join(d.task_definitions, "taskDefinitionArn")
    last = "element_at(split({0}, '/'), -1)"
    assumes = [
        edge(
            named.filter(f"{field} <> ''"), "assumes", task, a.role(last.format(field)), stable_ordinal("taskDefinitionArn"), assumed_via=f"'{field}'"
        )
        for field in ("taskRoleArn", "executionRoleArn")
    ]
    order = stable_ordinal("clusterArn", "serviceName")
    return [
        node(d.clusters, "ecs_cluster", cluster, a.root, stable_ordinal("clusterArn"), ecs_cluster_name=name, arn="clusterArn"),
        node(
            services, "ecs_service", service, cluster, order, ecs_service_name="serviceName", ecs_task_definition="taskDefinition", arn="serviceArn",
            ecs_target_group_arns="nullif(filter(loadBalancers.targetGroupArn, x -> x is not null), array())",
        ),
        node(
            named, "ecs_task_definition", task, None, stable_ordinal("taskDefinitionArn"), ecs_task_family="coalesce(family, 'unknown')",
            ecs_task_revision="coalesce(revision, 0)", ecs_container_images="nullif(filter(containerDefinitions.image, x -> x <> ''), array())",
            ecs_task_role_arn="taskRoleArn", ecs_execution_role_arn="executionRoleArn", arn="taskDefinitionArn",
        ),
    ], [
        edge(services, "contains", cluster, service, order),
        edge(groups, "protected_by", service, a.security_group("sg"), stable_ordinal("clusterArn", "serviceName", "sg")),
        edge(runs, "references", service, task, order),
        *assumes,
    ]


def elbv2(d: Dump, a: Account) -> Frames:
    """S7d: balancers, listeners, target groups; of several listeners per group the last counts."""
    balancer = a.regional("elasticloadbalancing", "'loadbalancer/'", "LoadBalancerName")
    listeners = d.in_order("listeners")
    ports = listeners.groupBy("LoadBalancerArn").agg(  # a balancer has a handful of listeners
        F.array_sort(F.collect_list(F.struct(PLACE, "Port", "Protocol", F.col("DefaultActions.Type").alias("actions")))).alias("listeners")
    ).withColumn("listeners", F.transform("listeners", lambda x: x.dropFields(PLACE)))
    lbs = d.load_balancers.join(ports, "LoadBalancerArn", "left")
    by_group = (
        listeners.select("LoadBalancerArn", "Port", "Protocol", PLACE, F.explode("DefaultActions.TargetGroupArn").alias("TargetGroupArn"))
        .filter("TargetGroupArn <> ''").groupBy("LoadBalancerArn", "TargetGroupArn").agg(F.max_by(F.struct("Port", "Protocol"), PLACE).alias("listener"))
    )
    groups = (
        d.target_groups.selectExpr("*", "explode(LoadBalancerArns) as LoadBalancerArn")
        .join(d.load_balancers.select("LoadBalancerArn", "LoadBalancerName"), "LoadBalancerArn")
        .join(by_group, ["LoadBalancerArn", "TargetGroupArn"], "left")
    )
    pool = a.regional("elasticloadbalancing", "'targetgroup/'", "LoadBalancerName", "'/'", "TargetGroupName")
    health = "if(HealthCheckEnabled, to_json(struct(HealthCheckProtocol as protocol, HealthCheckPath as path, HealthCheckIntervalSeconds as interval)), null)"
    guards = d.load_balancers.selectExpr("LoadBalancerName", "explode(SecurityGroups) as sg")
    return [
        node(
            lbs, "load_balancer", balancer, a.root, stable_ordinal("LoadBalancerArn"),
            lb_type="if(lower(coalesce(Type, 'application')) = 'application', 'alb', 'nlb')", lb_scheme="coalesce(Scheme, 'internal')",
            lb_dns_name="coalesce(DNSName, '')", lb_listeners="listeners", lb_state="coalesce(State.Code, 'unknown')", arn="LoadBalancerArn",
        ),
        node(
            groups, "backend_group", pool, a.root, stable_ordinal("LoadBalancerArn", "TargetGroupArn"), bg_name="TargetGroupName", bg_port="Port",
            bg_protocol="Protocol", bg_target_type="TargetType", bg_health_check=health, bg_backend_type="'aws_target_group'", arn="TargetGroupArn",
        ),
    ], [
        edge(guards, "protected_by", balancer, a.security_group("sg"), stable_ordinal("LoadBalancerName", "sg")),
        edge(
            groups, "routes_to", balancer, pool, stable_ordinal("LoadBalancerArn", "TargetGroupArn"),
            listener_port="nullif(listener.Port, 0)", listener_protocol="nullif(listener.Protocol, '')",
        ),
    ]


def iam(d: Dump, a: Account) -> Frames:
    """S7e: roles with trust policy, users with keys and MFA, local policies, attachments."""
    user = a.unregional("iam", "'user/'", "UserName")
    policy = "concat('urn:arn:aws:iam::', if(startswith(coalesce({arn}, ''), 'arn:aws:iam::aws:'), 'aws', '" + a.id + "'), ':policy/', PolicyName)"
    attached = policy.format(arn="PolicyArn")
    keys = d.access_keys.groupBy("UserName").agg(  # at most a few keys per user
        F.array_sort(F.collect_list(F.struct(F.col("AccessKeyId").alias("id"), F.col("Status").alias("status"), F.coalesce("CreateDate", F.lit("")).alias("created")))).alias("keys")
    )
    mfa = d.mfa_devices.groupBy("UserName").agg(F.lit(True).alias("mfa"))
    users = d.users.join(keys, "UserName", "left").join(mfa, "UserName", "left")
    local = a.unregional("iam", "'policy/'", "PolicyName")
    return [
        node(
            d.roles, "iam_role", a.role("RoleName"), a.root, stable_ordinal("RoleName"), role_name="RoleName",
            iam_trust_policy="try_parse_json(AssumeRolePolicyDocument)", arn="Arn",
        ),
        node(
            users, "iam_user", user, a.root, stable_ordinal("UserName"), iam_user_name="UserName", iam_access_keys="keys",
            iam_mfa_enabled="coalesce(mfa, false)", iam_last_activity="nullif(PasswordLastUsed, '')", arn="Arn",
        ),
        node(
            d.policies, "iam_policy", local, a.root, stable_ordinal("PolicyName"), iam_policy_name="PolicyName", iam_policy_arn="Arn",
            iam_policy_document="try_parse_json(Document)",
        ),
    ], [
        edge(d.role_policies, "attaches", attached, a.role("RoleName"), stable_ordinal("RoleName", "PolicyName"), privilege="'attached'"),
        edge(d.user_policies, "attaches", attached, user, stable_ordinal("UserName", "PolicyName"), privilege="'attached'"),
    ]


def rds(d: Dump, a: Account) -> Frames:
    """S7f: database instances and their groups."""
    urn = a.regional("rds", "'db:'", "DBInstanceIdentifier")
    guards = d.db_instances.selectExpr("DBInstanceIdentifier", "explode(VpcSecurityGroups.VpcSecurityGroupId) as sg").filter("sg <> ''")
    return [
        node(
            d.db_instances, "rds_instance", urn, a.root, stable_ordinal("DBInstanceIdentifier"), rds_instance_id="DBInstanceIdentifier",
            rds_engine="Engine", rds_endpoint="Endpoint.Address", rds_port="Endpoint.Port", rds_publicly_accessible="PubliclyAccessible",
            rds_encryption_enabled="StorageEncrypted", rds_multi_az="MultiAZ", arn="DBInstanceArn",
        )
    ], [edge(guards, "protected_by", urn, a.security_group("sg"), stable_ordinal("DBInstanceIdentifier", "sg"))]


def route53(d: Dump, a: Account) -> Frames:
    """S7g: records except SOA and NS; values from the records or else the alias."""
    zone = "element_at(split(Id, '/'), -1)"
    zones = d.hosted_zones.selectExpr(
        "Id as HostedZoneId", f"{zone} as zone_id", "rtrim('.', Name) as zone_name", "coalesce(Config.PrivateZone, false) as private"
    )
    records = d.record_sets.filter("coalesce(Type, '') not in ('SOA', 'NS')").join(zones, "HostedZoneId")
    name = "rtrim('.', coalesce(Name, ''))"
    values = "case when ResourceRecords is not null then ResourceRecords.Value when AliasTarget is not null then array(rtrim('.', AliasTarget.DNSName)) else array() end"
    return [
        node(
            records, "dns_record", f"concat('urn:arn:aws:route53:::hostedzone/', zone_id, '/recordset/', {name}, '/', Type)", a.root,
            stable_ordinal("zone_id", "Name", "Type"), dns_record_name=name, dns_record_type="Type", dns_zone_name="zone_name",
            dns_zone_private="private", dns_zone_id="zone_id", dns_ttl="TTL", dns_values=values,
        )
    ], []


def s3(d: Dump, a: Account) -> Frames:
    """S7h: buckets of this region; an empty location means us-east-1."""
    here = d.buckets.filter(F.coalesce(F.nullif("LocationConstraint", F.lit("")), F.lit("us-east-1")) == a.region)
    return [
        node(
            here, "s3_bucket", "concat('urn:arn:aws:s3:::', Name)", a.root, stable_ordinal("Name"), bucket_name="Name",
            arn="concat('arn:aws:s3:::', Name)", account_id=f"'{a.id}'", region=f"'{a.region}'",
        )
    ], []


def sso(d: Dump, a: Account) -> Frames:
    """S7i: groups, users, memberships, permission sets and assignments; unknown principals drop out."""
    group = a.unregional("identitystore", "'group/'", "GroupId")
    user = a.unregional("identitystore", "'user/'", "UserId")
    pset = a.unregional("sso", "'permission-set/'", "element_at(split(PermissionSetArn, '/'), -1)")
    email = "coalesce(get(filter(Emails, e -> e.Primary and e.Value <> ''), 0).Value, nullif(get(Emails, 0).Value, ''))"
    groups, users = d.sso_groups.select("GroupId"), d.sso_users.select("UserId")
    members = (
        d.sso_memberships.selectExpr("GroupId", "MemberId.UserId as UserId").join(users, "UserId", "left_semi").join(groups, "GroupId", "left_semi")
    )
    granted = d.in_order("account_assignments").join(d.permission_sets.select("PermissionSetArn"), "PermissionSetArn", "left_semi")
    people = granted.filter("PrincipalType = 'USER'").withColumnRenamed("PrincipalId", "UserId").join(users, "UserId", "left_semi")
    teams = granted.filter("PrincipalType = 'GROUP'").withColumnRenamed("PrincipalId", "GroupId").join(groups, "GroupId", "left_semi")
    assigned = lambda df, who: edge(
        df, "sso:assigned_to", who, pset, PLACE, account="AccountId", account_id="AccountId"
    )
    return [
        node(d.sso_groups, "sso_group", group, a.root, stable_ordinal("GroupId"), sso_group_id="GroupId", sso_group_name="coalesce(DisplayName, GroupId)"),
        node(
            d.sso_users, "sso_user", user, a.root, stable_ordinal("UserId"), sso_user_id="UserId", sso_user_name="coalesce(UserName, UserId)",
            sso_user_email=email, sso_user_external_id="get(ExternalIds, 0).Id",
        ),
        node(
            d.permission_sets, "aws:permission_set", pset, a.root, stable_ordinal("PermissionSetArn"),
            permission_set_name="coalesce(Name, element_at(split(PermissionSetArn, '/'), -1))", permission_set_arn="PermissionSetArn",
            permission_set_instance_arn="InstanceArn", permission_set_description="Description", permission_set_session_duration="SessionDuration",
        ),
    ], [
        edge(members, "member_of", user, group, stable_ordinal("GroupId", "UserId")),
        assigned(people, user),
        assigned(teams, group),
    ]


def _rules(column: str) -> str:
    """SQL text flattening permission entries to one rule per range or group reference."""
    base = "coalesce(p.IpProtocol, '-1') as protocol, p.FromPort as from_port, p.ToPort as to_port"
    v4 = f"transform(coalesce(p.IpRanges, array()), r -> struct({base}, r.CidrIp as cidr, cast(null as string) as sg_id, 'ipv4' as type))"
    v6 = f"transform(coalesce(p.Ipv6Ranges, array()), r -> struct({base}, r.CidrIpv6 as cidr, cast(null as string) as sg_id, 'ipv6' as type))"
    ref = f"transform(coalesce(p.UserIdGroupPairs, array()), r -> struct({base}, cast(null as string) as cidr, r.GroupId as sg_id, 'sg_ref' as type))"
    return f"flatten(transform(coalesce({column}, array()), p -> concat({v4}, {v6}, {ref})))"


def vpc(d: Dump, a: Account) -> Frames:
    """S7j: networks, security groups with flattened rules, group-to-group traffic, ACLs."""
    net = lambda key: a.regional("ec2", "'vpc/'", key)
    home = "coalesce(VpcId, 'unknown')"
    sg, acl = a.security_group("GroupId"), a.regional("ec2", "'network-acl/'", "NetworkAclId")
    refs = (
        d.security_groups.selectExpr("GroupId", "explode(IpPermissions) as p")
        .selectExpr("GroupId", "p.IpProtocol as proto", "p.FromPort as low", "p.ToPort as high", "explode(p.UserIdGroupPairs.GroupId) as source")
        .filter("source <> ''")
    )
    span = "case when low is null and high is null then 'all' when low <=> high then cast(low as string) else concat(coalesce(cast(low as string), 'None'), '-', coalesce(cast(high as string), 'None')) end"
    entries = "transform(Entries, e -> struct(e.RuleNumber as rule_number, e.Protocol as protocol, e.RuleAction as rule_action, e.Egress as egress, e.CidrBlock as cidr))"
    return [
        node(d.vpcs, "vpc", net("VpcId"), a.root, stable_ordinal("VpcId"), vpc_id="VpcId", vpc_cidr="CidrBlock"),
        node(
            d.security_groups, "security_group", sg, net(home), stable_ordinal("GroupId"), sg_id="GroupId", sg_name="GroupName",
            sg_rules_ingress=_rules("IpPermissions"), sg_rules_egress=_rules("IpPermissionsEgress"), vpc_id=home,
        ),
        node(d.network_acls, "nacl", acl, net(home), stable_ordinal("NetworkAclId"), nacl_id="NetworkAclId", nacl_rules=entries, vpc_id=home),
    ], [
        edge(d.security_groups, "contains", net(home), sg, stable_ordinal("GroupId")),
        edge(
            refs, "allows_traffic_to", a.security_group("source"), sg, stable_ordinal("GroupId", "source", "proto", "low", "high"),
            sg_rule_protocol="coalesce(proto, '-1')", sg_rule_port_range=span, sg_rule_direction="'ingress'",
        ),
        edge(d.network_acls, "contains", net(home), acl, stable_ordinal("NetworkAclId")),
    ]


SERVICES: dict[str, Callable[[Dump, Account], Frames]] = {
    "apigateway": apigateway, "ecr": ecr, "ecs": ecs, "elbv2": elbv2, "iam": iam,
    "rds": rds, "route53": route53, "s3": s3, "sso": sso, "vpc": vpc,
}
