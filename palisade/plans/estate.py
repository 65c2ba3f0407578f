"""A cloud estate derived from the star-schema tables, in the shape of API responses.

Every resource list is a projection of the given tables, so the loaders and
stitchers get inputs that grow with them.  Hot spots are kept on purpose: many
records point at few balancers, many services at few target groups.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.build import node_frame
from palisade.model import PartGraph
from palisade.plans.tables import Tables
from palisade.sources import okta
from palisade.sources.aws import Account, Dump, load_account

ACCOUNT = Account("123456789012", "us-east-1")
DOMAIN = "example.okta.com"

LB_ARN = "concat('arn:aws:elasticloadbalancing:us-east-1:123456789012:loadbalancer/app/lb-', s_suppkey, '/', substr(md5(s_name), 1, 16))"


def tg_arn(k: str) -> str:
    return f"concat('arn:aws:elasticloadbalancing:us-east-1:123456789012:targetgroup/tg-', {k}, '/0')"


def role_arn(name: str) -> str:
    return f"concat('arn:aws:iam::123456789012:role/', {name})"


def set_name(kind: str) -> str:
    return f"concat(initcap({kind}), ' Access')"


def set_arn(kind: str) -> str:
    return f"concat('arn:aws:sso:::permissionSet/ssoins-1/ps-', lower({kind}))"


TRUST = """concat('{"Version": "2012-10-17", "Statement": ', if(c_acctbal >= 0, '[', ''), '{"Effect": "', if(c_acctbal > 9000, 'Deny', 'Allow'),
'", "Action": ', if(c_acctbal >= 4000, '["sts:AssumeRole", "sts:TagSession"]', '"sts:AssumeRole"'), ', "Principal": ',
case c_mktsegment when 'BUILDING' then '"*"'
  when 'AUTOMOBILE' then concat('{"AWS": "', role, '"}')
  when 'MACHINERY' then concat('{"AWS": ["arn:aws:iam::', lpad(cast(c_nationkey as string), 12, '0'), ':root", "*"]}')
  when 'FURNITURE' then '{"Federated": ["arn:aws:iam::123456789012:saml-provider/Corp", "arn:aws:iam::123456789012:saml-provider/AWSSSO_0a1b_DO_NOT_DELETE", "accounts.example.com"]}'
  else '{"Service": "ec2.amazonaws.com"}' end,
if(c_acctbal < 0, ', "Condition": {"Bool": {"aws:MultiFactorAuthPresent": "true"}}', ''), '}', if(c_acctbal >= 0, ']', ''), '}')"""


class EstateDump(Dump):
    """API response items computed from the tables; each list is built when first used."""

    def __init__(self, t: Tables):
        super().__init__(t.spark, {})
        self.t = t

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name in ("t", "frames", "spark"):
            raise AttributeError(name)
        return super().__getattr__(name)

    @cached_property
    def hosted_zones(self) -> DataFrame:
        return self.t.nation.selectExpr(
            "concat('/hostedzone/Z', n_nationkey) as Id", "concat(lower(n_name), '.example.') as Name", "struct(n_regionkey = 4 as PrivateZone) as Config"
        )

    @cached_property
    def record_sets(self) -> DataFrame:
        lb = lambda k: f"concat('LB-', {k}, '.elb.amazonaws.com')"
        return self.t.customer.selectExpr(
            "concat('/hostedzone/Z', c_nationkey) as HostedZoneId", "concat('app', c_custkey, '.example.') as Name",
            "case c_mktsegment when 'BUILDING' then 'A' when 'MACHINERY' then 'CNAME' when 'HOUSEHOLD' then 'NS' else 'TXT' end as Type",
            "300L as TTL",
            f"case when c_mktsegment = 'MACHINERY' then array(struct(concat('https://rest', c_nationkey, '.execute-api.us-east-1.amazonaws.com/') as Value), struct({lb('c_custkey')} as Value)) end as ResourceRecords",
            f"case when c_mktsegment = 'BUILDING' then struct(concat({lb('c_nationkey')}, '.') as DNSName) end as AliasTarget",
        )

    @cached_property
    def load_balancers(self) -> DataFrame:
        return self.t.supplier.selectExpr(
            "concat('lb-', s_suppkey) as LoadBalancerName", "if(s_acctbal > 5000, 'network', 'application') as Type",
            "if(s_nationkey < 15, 'internet-facing', 'internal') as Scheme", "concat('lb-', s_suppkey, '.ELB.amazonaws.com') as DNSName",
            f"{LB_ARN} as LoadBalancerArn", "struct('active' as Code) as State", "array(concat('sg-', s_nationkey)) as SecurityGroups",
        )

    @cached_property
    def listeners(self) -> DataFrame:
        """Two of each balancer; the plain one was added last to every other balancer."""
        ports = (
            "explode(array(struct(80 as Port, 'HTTP' as Protocol, s_suppkey * 4 + if(s_suppkey % 2 = 0, 0, 3) as place),"
            " struct(443 as Port, 'HTTPS' as Protocol, s_suppkey * 4 + 1 as place))) as l"
        )
        actions = f"array(struct('forward' as Type, {tg_arn('s_suppkey')} as TargetGroupArn)) as DefaultActions"
        return self.t.supplier.selectExpr(f"{LB_ARN} as LoadBalancerArn", actions, ports).selectExpr(
            "LoadBalancerArn", "l.Port as Port", "l.Protocol as Protocol", "DefaultActions", "l.place as _place"
        )

    @cached_property
    def target_groups(self) -> DataFrame:
        return self.t.supplier.selectExpr(
            f"array({LB_ARN}) as LoadBalancerArns", "concat('tg-', s_suppkey) as TargetGroupName", f"{tg_arn('s_suppkey')} as TargetGroupArn",
            "8080 as Port", "'HTTP' as Protocol", "'ip' as TargetType", "s_acctbal > 0 as HealthCheckEnabled", "'HTTP' as HealthCheckProtocol",
            "'/health' as HealthCheckPath", "30 as HealthCheckIntervalSeconds",
        )

    @cached_property
    def clusters(self) -> DataFrame:
        return self.t.region.selectExpr("concat('arn:aws:ecs:us-east-1:123456789012:cluster/c', r_regionkey) as clusterArn")

    @cached_property
    def services(self) -> DataFrame:
        homes = self.t.nation.selectExpr("n_nationkey as c_nationkey", "n_regionkey")
        return self.t.customer.join(homes, "c_nationkey").selectExpr(
            "concat('arn:aws:ecs:us-east-1:123456789012:cluster/c', n_regionkey) as clusterArn", "concat('svc-', c_custkey) as serviceName",
            "concat('arn:aws:ecs:us-east-1:123456789012:service/svc-', c_custkey) as serviceArn",
            "concat('arn:aws:ecs:us-east-1:123456789012:task-definition/', lower(c_mktsegment), ':', c_nationkey) as taskDefinition",
            f"array(struct({tg_arn('c_nationkey')} as targetGroupArn), struct({tg_arn('c_custkey')} as targetGroupArn)) as loadBalancers",
            "struct(struct(array(concat('sg-', c_nationkey), 'sg-gone') as securityGroups) as awsvpcConfiguration) as networkConfiguration",
        )

    @cached_property
    def task_definitions(self) -> DataFrame:
        return self.t.customer.select("c_mktsegment", "c_nationkey").distinct().selectExpr(
            "concat('arn:aws:ecs:us-east-1:123456789012:task-definition/', lower(c_mktsegment), ':', c_nationkey) as taskDefinitionArn",
            "lower(c_mktsegment) as family", "cast(c_nationkey as bigint) as revision",
            "array(struct(concat('123456789012.dkr.ecr.us-east-1.amazonaws.com/', lower(c_mktsegment), ':v', c_nationkey) as image), struct(concat('docker.io/envoy@sha256:', c_nationkey) as image)) as containerDefinitions",
            f"{role_arn('concat(' + repr('cust-') + ', c_nationkey)')} as taskRoleArn",
            f"case when c_mktsegment = 'BUILDING' then {role_arn(repr('exec'))} end as executionRoleArn",
        )

    @cached_property
    def repositories(self) -> DataFrame:
        return self.t.customer.select("c_mktsegment").distinct().selectExpr(
            "lower(c_mktsegment) as repositoryName", "concat('123456789012.dkr.ecr.us-east-1.amazonaws.com/', lower(c_mktsegment)) as repositoryUri",
            "concat('arn:aws:ecr:us-east-1:123456789012:repository/', lower(c_mktsegment)) as repositoryArn",
        )

    @cached_property
    def images(self) -> DataFrame:
        return self.t.customer.selectExpr(
            "lower(c_mktsegment) as repositoryName", "concat('sha256:', c_custkey) as imageDigest",
            "case when c_acctbal > 0 then array(concat('v', c_nationkey), 'latest') else array() end as imageTags",
            "'2024-01-01' as imagePushedAt", "c_custkey as imageSizeInBytes",
        )

    @cached_property
    def image_manifests(self) -> DataFrame:
        kinds = (
            "explode(array(struct('m' as kind), struct('c' as kind))) as x"
        )
        return self.t.customer.selectExpr("*", kinds).selectExpr(
            "lower(c_mktsegment) as repositoryName",
            "struct(concat(if(x.kind = 'm', 'sha256:', 'sha256:cfg'), c_custkey) as imageDigest) as imageId",
            "if(x.kind = 'm', concat('{\"config\": {\"digest\": \"sha256:cfg', c_custkey, '\"}}'), concat('{\"config\": {\"Labels\": {\"org.opencontainers.image.source\": \"https://git.example.com/n', c_nationkey, '\"}}}')) as imageManifest",
        )

    @cached_property
    def roles(self) -> DataFrame:
        own = self.t.customer.selectExpr("*", f"{role_arn('concat(' + repr('cust-') + ', c_nationkey)')} as role").selectExpr(
            "concat('cust-', c_custkey) as RoleName", f"{role_arn('concat(' + repr('cust-') + ', c_custkey)')} as Arn", f"{TRUST} as AssumeRolePolicyDocument"
        )
        name = "concat('AWSReservedSSO_', initcap(p_type), 'Access_', substr(md5(p_type), 1, 16))"
        reserved = self.t.part.select("p_type").distinct().selectExpr(f"{name} as RoleName", f"{role_arn(name)} as Arn", "cast(null as string) as AssumeRolePolicyDocument")
        return own.unionByName(reserved)

    @cached_property
    def role_policies(self) -> DataFrame:
        return self.t.customer.selectExpr(
            "concat('cust-', c_custkey) as RoleName", "concat('p-', lower(c_mktsegment)) as PolicyName",
            "if(c_mktsegment = 'BUILDING', 'arn:aws:iam::aws:policy/ReadOnly', 'arn:aws:iam::123456789012:policy/x') as PolicyArn",
        )

    @cached_property
    def policies(self) -> DataFrame:
        return self.t.customer.select("c_mktsegment").distinct().selectExpr(
            "concat('p-', lower(c_mktsegment)) as PolicyName", "concat('arn:aws:iam::123456789012:policy/p-', lower(c_mktsegment)) as Arn",
            "'{\"Version\": \"2012-10-17\", \"Statement\": []}' as Document",
        )

    @cached_property
    def users(self) -> DataFrame:
        return self.t.supplier.selectExpr("s_name as UserName", "concat('arn:aws:iam::123456789012:user/', s_name) as Arn", "'2024-05-01' as PasswordLastUsed")

    @cached_property
    def access_keys(self) -> DataFrame:
        return self.t.supplier.filter("s_acctbal > 0").selectExpr(
            "s_name as UserName", "concat('AKIA', s_suppkey) as AccessKeyId", "if(s_nationkey < 5, 'Inactive', 'Active') as Status", "'2023-01-01' as CreateDate"
        )

    @cached_property
    def mfa_devices(self) -> DataFrame:
        return self.t.supplier.filter("s_nationkey < 10").selectExpr("s_name as UserName", "concat('mfa', s_suppkey) as SerialNumber")

    @cached_property
    def db_instances(self) -> DataFrame:
        return self.t.supplier.selectExpr(
            "concat('db-', s_suppkey) as DBInstanceIdentifier", "'postgres' as Engine", "struct(concat('db', s_suppkey, '.rds.example') as Address, 5432 as Port) as Endpoint",
            "s_acctbal < 0 as PubliclyAccessible", "true as StorageEncrypted", "false as MultiAZ", "concat('arn:aws:rds:us-east-1:123456789012:db:db-', s_suppkey) as DBInstanceArn",
            "array(struct(concat('sg-', s_nationkey) as VpcSecurityGroupId)) as VpcSecurityGroups",
        )

    @cached_property
    def buckets(self) -> DataFrame:
        return self.t.documents.select("source", "lang").distinct().selectExpr(
            "concat('bucket-', source, '-', lang) as Name", "if(lang = 'de', 'eu-west-1', '') as LocationConstraint"
        )

    @cached_property
    def sso_groups(self) -> DataFrame:
        return self.t.events.select("event_type").distinct().selectExpr("concat('g-', event_type) as GroupId", "event_type as DisplayName")

    @cached_property
    def _people(self) -> DataFrame:
        return self.t.events.groupBy("user_id").agg(F.max("value").alias("top"))

    @cached_property
    def sso_users(self) -> DataFrame:
        return self._people.selectExpr(
            "concat('u-', user_id) as UserId", "concat('user', user_id) as UserName",
            "array(struct('other@example.com' as Value, false as Primary), struct(concat('User', user_id, '@Example.com') as Value, true as Primary)) as Emails",
            "case when top > 60 then array(struct(concat('okta', user_id) as Id)) end as ExternalIds",
        )

    @cached_property
    def sso_memberships(self) -> DataFrame:
        return self.t.events.filter("value > 20").select("event_type", "user_id").distinct().selectExpr(
            "concat('g-', event_type) as GroupId", "struct(concat('u-', user_id) as UserId) as MemberId"
        )

    @cached_property
    def permission_sets(self) -> DataFrame:
        return self.t.part.select("p_type").distinct().selectExpr(
            f"{set_arn('p_type')} as PermissionSetArn", "'arn:aws:sso:::instance/ssoins-1' as InstanceArn", f"{set_name('p_type')} as Name",
            "cast(null as string) as Description", "'PT8H' as SessionDuration",
        )

    @cached_property
    def account_assignments(self) -> DataFrame:
        people = self.t.part.select("p_type", "p_size").distinct().selectExpr(
            f"{set_arn('p_type')} as PermissionSetArn", "if(p_size > 10, '123456789012', '999999999999') as AccountId", "'USER' as PrincipalType", "concat('u-', p_size) as PrincipalId",
            "cast(p_size as bigint) as _place",
        )
        teams = self.t.events.select("event_type").distinct().selectExpr("event_type", "explode(array('ECONOMY', 'PROMO')) as p_type").selectExpr(
            f"{set_arn('p_type')} as PermissionSetArn", "'123456789012' as AccountId", "'GROUP' as PrincipalType", "concat('g-', event_type) as PrincipalId",
            "cast(1000 - ascii(event_type) as bigint) as _place",
        )
        return people.unionByName(teams)

    @cached_property
    def vpcs(self) -> DataFrame:
        return self.t.region.selectExpr("concat('vpc-', r_regionkey) as VpcId", "concat('10.', r_regionkey, '.0.0/16') as CidrBlock")

    @cached_property
    def security_groups(self) -> DataFrame:
        rule = (
            "array(struct('tcp' as IpProtocol, 443 as FromPort, if(n_regionkey = 1, 8443, 443) as ToPort, "
            "array(struct(if(n_regionkey = 0, '0.0.0.0/0', '10.0.0.0/8') as CidrIp)) as IpRanges, "
            "array(struct('::/0' as CidrIpv6)) as Ipv6Ranges, array(struct(concat('sg-', n_nationkey + 1) as GroupId)) as UserIdGroupPairs))"
        )
        return self.t.nation.selectExpr(
            "concat('sg-', n_nationkey) as GroupId", "n_name as GroupName", "concat('vpc-', n_regionkey) as VpcId", f"{rule} as IpPermissions", f"{rule} as IpPermissionsEgress"
        )

    @cached_property
    def network_acls(self) -> DataFrame:
        return self.t.region.selectExpr(
            "concat('acl-', r_regionkey) as NetworkAclId", "concat('vpc-', r_regionkey) as VpcId",
            "array(struct(100 as RuleNumber, '-1' as Protocol, 'allow' as RuleAction, false as Egress, '0.0.0.0/0' as CidrBlock)) as Entries",
        )

    @cached_property
    def http_apis(self) -> DataFrame:
        return self.t.pages.selectExpr("concat('api', page_id) as ApiId", "url as ApiEndpoint", "if(startswith(url, 'https'), 'HTTP', 'WEBSOCKET') as ProtocolType")

    @cached_property
    def http_integrations(self) -> DataFrame:
        """Pages integrate with the balancer whose number is the length of their URL."""
        target = self.t.supplier.selectExpr("s_suppkey as n", f"replace({LB_ARN}, 'loadbalancer/', 'listener/') as arn")
        return self.t.pages.selectExpr("concat('api', page_id) as ApiId", "cast(length(url) as bigint) as n").join(target, "n").selectExpr(
            "ApiId", "concat(arn, '/f00d') as IntegrationUri"
        )

    @cached_property
    def rest_apis(self) -> DataFrame:
        return self.t.nation.selectExpr(
            "concat('rest', n_nationkey) as id", "struct(if(n_regionkey = 4, array('PRIVATE'), array('REGIONAL')) as types) as endpointConfiguration"
        )


def directory(t: Tables) -> dict[str, DataFrame]:
    """The Okta side: some people share the external id, all share the e-mail (in lower case)."""
    people = t.events.groupBy("user_id").agg(F.max("value").alias("top"))
    ident = "concat(if(top > 50, 'okta', 'x'), user_id)"
    pairs = t.events.select("event_type", "user_id").distinct().join(people, "user_id")
    langs = t.documents.select("lang").distinct()
    return {
        "users": people.selectExpr(
            f"{ident} as id", "'ACTIVE' as status",
            "struct(concat('user', user_id, '@example.com') as email, concat('user', user_id) as login, 'User' as firstName, cast(user_id as string) as lastName) as profile",
        ),
        "groups": t.events.select("event_type").distinct().selectExpr("concat('grp-', event_type) as id", "struct(event_type as name, cast(null as string) as description) as profile"),
        "apps": langs.selectExpr("concat('app-', lang) as id", "lang as name", "upper(lang) as label", "'SAML_2_0' as signOnMode", "'ACTIVE' as status"),
        "group_users": pairs.selectExpr("concat('grp-', event_type) as group_id", f"{ident} as user_id"),
        "app_users": t.documents.selectExpr("concat('app-', lang) as app_id", "concat('okta', doc_id) as user_id"),
        "app_groups": t.events.select("event_type").distinct().selectExpr("if(event_type in ('view', 'click'), 'app-en', 'app-fr') as app_id", "concat('grp-', event_type) as group_id"),
        "app_group_push": t.events.select("event_type").distinct().selectExpr("if(event_type = 'view', 'app-none', 'app-de') as app_id", "concat('grp-', event_type) as source_group_id"),
    }


def databases(t: Tables) -> DataFrame:
    """Databases on some of the instances' hosts."""
    return node_frame(
        t.supplier.filter("s_acctbal > 0"), "database", "concat('urn:onprem:postgres:db', s_suppkey, '.rds.example:5432:app')", None, "s_suppkey",
        database_name="'app'", host="concat('db', s_suppkey, '.rds.example')", port="5432",
    )


def aws_graph(spark: SparkSession, folder: str, services: list[str] | None = None) -> PartGraph:
    return load_account(EstateDump(Tables(spark, folder)), ACCOUNT, services)


def okta_graph(spark: SparkSession, folder: str) -> PartGraph:
    return okta.load_directory(directory(Tables(spark, folder)), DOMAIN)


def with_databases(graph: PartGraph, t: Tables) -> PartGraph:
    return PartGraph([*graph.node_parts, ("database", databases(t))], graph.edge_parts)
