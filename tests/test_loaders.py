import json

import pytest
from pyspark.sql import functions as F

from palisade.functions import meta
from palisade.model import NODE_TYPES, PartGraph
from palisade.operators.search import settle_edges
from palisade.operators.stitch import identity
from palisade.sources import catalog, lockfile, okta
from palisade.sources.aws import Account, Dump, load_account

ACCOUNT = Account("1", "us-east-1")


def write(folder, **resources):
    for name, items in resources.items():
        (folder / f"{name}.json").write_text("\n".join(json.dumps(i) for i in items))


def test_aws_dumps_from_files(spark, tmp_path):
    rule = {"IpProtocol": "tcp", "FromPort": 80, "ToPort": 90, "IpRanges": [{"CidrIp": "0.0.0.0/0"}], "UserIdGroupPairs": [{"GroupId": "sg-2"}]}
    write(
        tmp_path,
        roles=[{"RoleName": "app", "Arn": "arn:aws:iam::1:role/app", "AssumeRolePolicyDocument": json.dumps({"Statement": []})}],
        role_policies=[{"RoleName": "app", "PolicyName": "ReadOnly", "PolicyArn": "arn:aws:iam::aws:policy/ReadOnly"}],
        security_groups=[{"GroupId": "sg-1", "GroupName": "web", "IpPermissions": [rule]}],
        rest_apis=[{"id": "r1", "endpointConfiguration": {"types": ["REGIONAL", "PRIVATE"]}}, {"id": "r2"}],
        record_sets=[{"HostedZoneId": "/hostedzone/Z", "Name": "a.x.", "Type": "A", "AliasTarget": {"DNSName": "lb.x."}}, {"HostedZoneId": "/hostedzone/Z", "Name": "x.", "Type": "SOA"}],
        hosted_zones=[{"Id": "/hostedzone/Z", "Name": "x."}],
        domain_names=[{"DomainName": "api.x", "DomainNameConfigurations": [{"ApiGatewayDomainName": "d-1.x"}]}], api_mappings=[{"DomainName": "api.x", "ApiId": "h1"}],
        http_apis=[{"ApiId": "h1", "ApiEndpoint": "https://h1.x", "ProtocolType": "HTTP"}],
    )
    g = load_account(Dump.from_folder(spark, str(tmp_path)), ACCOUNT)
    assert isinstance(g, PartGraph)
    seen = {r.urn: r for r in g.nodes.collect()}
    assert set(r.node_type for r in seen.values()) <= set(NODE_TYPES)
    sg = seen["urn:arn:aws:ec2:us-east-1:1:security-group/sg-1"].metadata
    assert [(r.cidr, r.sg_id, r.type) for r in sg.sg_rules_ingress] == [("0.0.0.0/0", None, "ipv4"), (None, "sg-2", "sg_ref")] and sg.vpc_id == "unknown"
    scheme = lambda k: seen[f"urn:arn:aws:apigateway:us-east-1::/apis/{k}"].metadata
    assert (scheme("r1").lb_scheme, scheme("r2").lb_scheme, scheme("r2").api_gw_endpoint_type) == ("internal", "internet-facing", "EDGE")
    assert scheme("h1").api_gw_custom_domains == ["api.x", "d-1.x"]
    assert seen["urn:arn:aws:route53:::hostedzone/Z/recordset/a.x/A"].metadata.dns_values == ["lb.x"]
    edges = {(r.from_urn, r.to_urn, r.edge_type) for r in g.edges.collect()}
    assert ("urn:arn:aws:iam::aws:policy/ReadOnly", "urn:arn:aws:iam::1:role/app", "attaches") in edges
    assert ("urn:aws:account:1:us-east-1:root", "urn:arn:aws:iam::1:role/app", "contains") in edges
    traffic = g.edges_of("allows_traffic_to").first()
    assert (traffic.from_urn[-4:], traffic.to_urn[-4:], traffic.metadata.sg_rule_port_range) == ("sg-2", "sg-1", "80-90")


def test_okta_drops_unknown_ends(spark, tmp_path):
    write(
        tmp_path, users=[{"id": "u", "profile": {"email": "a@x", "firstName": "A", "lastName": ""}}], groups=[{"id": "g", "profile": {"name": "G"}}],
        apps=[{"id": "a", "name": "n"}, {"id": ""}], group_users=[{"group_id": "g", "user_id": "u"}, {"group_id": "g", "user_id": "gone"}],
        app_users=[{"app_id": "a", "user_id": "u"}], app_groups=[{"app_id": "a", "group_id": "g"}], app_group_push=[{"app_id": "a", "source_group_id": "nope"}],
    )
    g = okta.load_directory(okta.read_extract(spark, str(tmp_path)), "x.okta.com")
    people = g.of_type("person").first()
    assert people.urn == "urn:okta:idp:x.okta.com::user/u" and people.metadata.person_display_name == "A"
    assert sorted(r.edge_type for r in g.edges.collect()) == ["okta:assigned_to", "okta:assigned_to", "okta:part_of"]


def test_catalog_shape(spark):
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    columns = [("public", t, c, i + 1, "varchar", True, 20, None, None) for t, cs in (("users", ["id", "email"]), ("orders", ["id", "user_id", "total"])) for i, c in enumerate(cs)]
    g = catalog.load_catalog(
        {
            "schemata": frame([("public",), ("pg_catalog",)], "schema_name string"),
            "tables": frame([("public", "users", "BASE TABLE"), ("public", "orders", "BASE TABLE"), ("pg_catalog", "x", "BASE TABLE"), ("public", "tmp", "LOCAL TEMPORARY")], "table_schema string, table_name string, table_type string"),
            "columns": frame(columns, "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable boolean, character_maximum_length int, numeric_precision int, numeric_scale int"),
            "foreign_keys": frame([("fk", "public", "orders", "user_id", "public", "users", "id", 1)], "constraint_name string, fk_schema string, fk_table string, fk_column string, ref_schema string, ref_table string, ref_column string, ordinal_position int"),
            "roles": frame([("app", True, False), ("pg_monitor", False, False)], "role_name string, can_login boolean, is_superuser boolean"),
            "grants": frame([("app", "public", "users", "ALL", True), ("app", "public", "users", "UPDATE", False), ("ghost", "public", "users", "SELECT", False)], "grantee string, table_schema string, table_name string, privilege_type string, is_grantable boolean"),
        }, "db", "h", 5432,
    )
    assert g.nodes.count() == 10  # the nine of the structure and one role
    assert g.edges_of("references").first().to_urn == "urn:onprem:postgres:h:5432:db/public/users/id"
    grants = {(r.edge_type, tuple(r.metadata.privileges), r.metadata.is_grantable) for r in g.edges_of("reads", "writes").collect()}
    assert grants == {("reads", ("ALL",), True), ("writes", ("ALL", "UPDATE"), True)}


def test_lock_file_and_vulnerabilities(spark):
    text = '[[package]]\nname = "a"\nversion = "1"\ndependencies = [{ name = "b" }, { name = "gone" }]\n[[package]]\nname = "b"\nversion = "2"\n[[package]]\nname = "local"\n'
    rows = lockfile.packages(spark.createDataFrame([("urn:cb", text), ("urn:bad", "= broken")], "codebase_urn string, source string"))
    osv = spark.createDataFrame([("b", "2", [("GHSA-1", ["CVE-2", "CVE-1"]), ("CVE-1", None)])], "name string, version string, vulns array<struct<id:string,aliases:array<string>>>")
    g = lockfile.load_lock(rows, osv)
    deps = g.of_type("dependency")
    assert {(r.urn, r.c) for r in deps.select("urn", meta.get(deps, "cve_ids").alias("c")).collect()} == {("urn:cb/dep/a", None), ("urn:cb/dep/b", "CVE-1,CVE-2")}
    assert sorted((r.from_urn, r.to_urn) for r in g.edges_of("depends_on").collect()) == [
        ("urn:cb/dep/a", "urn:cb/dep/b"), ("urn:cb/uv.lock", "urn:cb/dep/a"), ("urn:cb/uv.lock", "urn:cb/dep/b"),
    ]


def test_column_samples(spark):
    table = spark.range(100).withColumn("x", F.when(F.col("id") > 3, F.col("id") % 30))
    assert catalog.sample_values(table, "x").count() == 20
    assert catalog.sample_values(table, "x", 99).count() == 30
    assert catalog.sample_values(table, "missing").count() == 0


@pytest.mark.parametrize("files", [1, 3])
def test_items_keep_their_place(spark, tmp_path, files):
    """Splits of a file and files of a folder are read in any order; places grow along them all the same."""
    n = 4000
    lines = [json.dumps({"LoadBalancerArn": "lb", "Port": i, "Protocol": "TCP"}) for i in range(n)]
    place = tmp_path / "listeners.json"
    if files == 1:
        place.write_text("\n".join(lines))
    else:
        place.mkdir()
        for k in range(files):
            (place / f"{k}.json").write_text("\n".join(lines[k * n // files : (k + 1) * n // files]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = Dump.from_folder(spark, str(tmp_path)).in_order("listeners")
        assert rows.rdd.getNumPartitions() > 4
        assert [r.Port for r in rows.repartition(7).orderBy("_place").collect()] == list(range(n))
        assert rows.select("_place").distinct().count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_last_listener_and_last_group_win(spark, tmp_path):
    arn = "arn:aws:elasticloadbalancing:us-east-1:1:loadbalancer/app/lb/1"
    write = lambda name, rows: (tmp_path / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows))
    write("load_balancers", [{"LoadBalancerName": "lb", "LoadBalancerArn": arn}])
    write("target_groups", [{"LoadBalancerArns": [arn], "TargetGroupName": "tg", "TargetGroupArn": "tg"}])
    forward = [{"Type": "forward", "TargetGroupArn": "tg"}]
    write("listeners", [{"LoadBalancerArn": arn, "Port": p, "Protocol": "TCP", "DefaultActions": forward} for p in (8080, 9000, 81)])
    account = Account("1", "us-east-1")
    g = load_account(Dump.from_folder(spark, str(tmp_path)), account, ["elbv2"])
    assert [r.metadata.listener_port for r in g.edges_of("routes_to").collect()] == [81]
    assert [[x[0] for x in r.metadata.lb_listeners] for r in g.of_type("load_balancer").collect()] == [[8080, 9000, 81]]
    write("sso_instances", [{"InstanceArn": "i", "IdentityStoreId": "d"}])
    write("sso_groups", [{"GroupId": "g1"}, {"GroupId": "g2"}])
    write("sso_users", [{"UserId": "u"}])
    write("sso_memberships", [{"GroupId": g, "MemberId": {"UserId": "u"}} for g in ("g1", "g2")])
    write("permission_sets", [{"PermissionSetArn": "arn:aws:sso:::permissionSet/i/ps", "InstanceArn": "i", "Name": "Admin"}])
    grant = lambda kind, who: {"PermissionSetArn": "arn:aws:sso:::permissionSet/i/ps", "AccountId": "1", "PrincipalType": kind, "PrincipalId": who}
    write("roles", [{"RoleName": "AWSReservedSSO_Admin_0123456789abcdef", "Arn": "arn:aws:iam::1:role/AWSReservedSSO_Admin_0123456789abcdef"}])
    for order in (["g2", "g1"], ["g1", "g2"]):
        write("account_assignments", [grant("GROUP", order[0]), grant("GROUP", order[1]), grant("USER", "u")])
        g = load_account(Dump.from_folder(spark, str(tmp_path)), account, ["sso", "iam"])
        kept = settle_edges(identity.sso_to_iam(g)).filter("from_urn like '%user/u'").collect()
        assert [r.metadata.via_group.rsplit("/", 1)[-1] for r in kept] == [order[1]]
