"""AWS API responses kept as JSON lines: one file (or folder) per resource, one item per line."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.build import stable_ordinal

log = logging.getLogger(__name__)

# --- fixed values: the response fields the loaders read, per resource ---------
SCHEMAS: dict[str, str] = {
    "http_apis": "ApiId string, ApiEndpoint string, ProtocolType string",
    "http_integrations": "ApiId string, IntegrationUri string",
    "domain_names": "DomainName string, DomainNameConfigurations array<struct<ApiGatewayDomainName:string>>",
    "api_mappings": "DomainName string, ApiId string",
    "rest_apis": "id string, endpointConfiguration struct<types:array<string>>",
    "repositories": "repositoryName string, repositoryUri string, repositoryArn string",
    "images": "repositoryName string, imageDigest string, imageTags array<string>, imagePushedAt string, imageSizeInBytes bigint",
    "image_manifests": "repositoryName string, imageId struct<imageDigest:string>, imageManifest string",
    "clusters": "clusterArn string",
    "services": "clusterArn string, serviceName string, serviceArn string, taskDefinition string,"
    " loadBalancers array<struct<targetGroupArn:string>>,"
    " networkConfiguration struct<awsvpcConfiguration:struct<securityGroups:array<string>>>",
    "task_definitions": "taskDefinitionArn string, family string, revision bigint,"
    " containerDefinitions array<struct<image:string>>, taskRoleArn string, executionRoleArn string",
    "load_balancers": "LoadBalancerName string, Type string, Scheme string, DNSName string, LoadBalancerArn string,"
    " State struct<Code:string>, SecurityGroups array<string>",
    "listeners": "LoadBalancerArn string, Port int, Protocol string, DefaultActions array<struct<Type:string,TargetGroupArn:string>>",
    "target_groups": "LoadBalancerArns array<string>, TargetGroupName string, TargetGroupArn string, Port int, Protocol string,"
    " TargetType string, HealthCheckEnabled boolean, HealthCheckProtocol string, HealthCheckPath string, HealthCheckIntervalSeconds int",
    "roles": "RoleName string, Arn string, AssumeRolePolicyDocument string",
    "role_policies": "RoleName string, PolicyName string, PolicyArn string",
    "users": "UserName string, Arn string, PasswordLastUsed string",
    "user_policies": "UserName string, PolicyName string, PolicyArn string",
    "access_keys": "UserName string, AccessKeyId string, Status string, CreateDate string",
    "mfa_devices": "UserName string, SerialNumber string",
    "policies": "PolicyName string, Arn string, Document string",
    "db_instances": "DBInstanceIdentifier string, Engine string, Endpoint struct<Address:string,Port:int>, PubliclyAccessible boolean,"
    " StorageEncrypted boolean, MultiAZ boolean, DBInstanceArn string, VpcSecurityGroups array<struct<VpcSecurityGroupId:string>>",
    "hosted_zones": "Id string, Name string, Config struct<PrivateZone:boolean>",
    "record_sets": "HostedZoneId string, Name string, Type string, TTL bigint,"
    " ResourceRecords array<struct<Value:string>>, AliasTarget struct<DNSName:string>",
    "buckets": "Name string, LocationConstraint string",
    "sso_instances": "InstanceArn string, IdentityStoreId string",
    "sso_groups": "GroupId string, DisplayName string",
    "sso_users": "UserId string, UserName string, Emails array<struct<Value:string,Primary:boolean>>, ExternalIds array<struct<Id:string>>",
    "sso_memberships": "GroupId string, MemberId struct<UserId:string>",
    "permission_sets": "PermissionSetArn string, InstanceArn string, Name string, Description string, SessionDuration string",
    "account_assignments": "PermissionSetArn string, AccountId string, PrincipalType string, PrincipalId string",
    "vpcs": "VpcId string, CidrBlock string",
    "security_groups": "GroupId string, GroupName string, VpcId string,"
    " IpPermissions array<struct<IpProtocol:string,FromPort:int,ToPort:int,IpRanges:array<struct<CidrIp:string>>,"
    "Ipv6Ranges:array<struct<CidrIpv6:string>>,UserIdGroupPairs:array<struct<GroupId:string>>>>,"
    " IpPermissionsEgress array<struct<IpProtocol:string,FromPort:int,ToPort:int,IpRanges:array<struct<CidrIp:string>>,"
    "Ipv6Ranges:array<struct<CidrIpv6:string>>,UserIdGroupPairs:array<struct<GroupId:string>>>>",
    "network_acls": "NetworkAclId string, VpcId string,"
    " Entries array<struct<RuleNumber:int,Protocol:string,RuleAction:string,Egress:boolean,CidrBlock:string>>",
}


#: The place of an item in its resource, below 2^48.
PLACE = "_place"


class Dump:
    """Response items by resource name; a missing resource reads as empty.

    Some answers depend on which of several items came last.  Spark reads the parts of a file in any
    order, so :meth:`in_order` numbers items by their place; a frame may bring its own ``_place``.
    """

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame], of_files: bool = False):
        self.spark = spark
        self.frames = frames
        self.of_files = of_files

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str) -> Dump:
        """Read ``{folder}/{resource}.json``; a declared schema spares the inference pass."""
        frames = {}
        for name, schema in SCHEMAS.items():
            try:
                frames[name] = spark.read.schema(schema).json(f"{folder}/{name}.json")
            except AnalysisException:
                log.info("no %s in %s", name, folder)
        return cls(spark, frames, of_files=True)

    def in_order(self, name: str) -> DataFrame:
        """The items of a resource with ``_place``: files by name, then items as they stand in them.

        An item takes a byte at least, so the start of its split and its number within
        the split add up to a number that grows along the file; files follow each other by their sizes.
        Items of frames that state no order are placed by a hash of theirs.
        """
        rows = getattr(self, name)
        if PLACE in rows.columns:
            return rows
        if not self.of_files or name not in self.frames:
            return rows.selectExpr("*", f"{stable_ordinal(*rows.columns)} as {PLACE}")
        own = rows.columns
        within = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), within.alias("_within"))
        if len(rows.inputFiles()) == 1:
            return placed.select(*own, F.col("_within").alias(PLACE))
        sizes = rows.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_size").alias("_size")).distinct()
        before = F.coalesce(F.sum("_size").over(Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per file
        starts = sizes.select("_path", before.alias("_before"))
        return placed.join(starts, F.col("_file") == F.col("_path")).select(*own, (F.col("_before") + F.col("_within")).alias(PLACE))

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        if name in self.frames:
            return self.frames[name]
        return self.spark.createDataFrame([], SCHEMAS[name])
