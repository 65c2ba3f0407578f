import random

import pytest
from conftest import pairs

from palisade.operators.stitch import code, containers, identity, network


def test_orm_class_wins_rules(make_graph):
    g = make_graph([
        ("urn:c1", "class", {"class_name": "User", "orm_table": "users"}), ("urn:c2", "class", {"class_name": "User", "orm_table": "users"}),
        ("urn:c3", "class", {"class_name": "Other"}), ("urn:t1", "table", {"table_name": "users"}), ("urn:t2", "table", {"table_name": "users"}),
    ])
    assert pairs(code.orm_class_to_table(g), "orm_class", "confidence") == [("urn:c2", "urn:t1", "User", "1.0")]


def test_function_reads_table_by_substring(make_graph, spark):
    g = make_graph([
        ("urn:c", "class", {"class_name": "User", "orm_table": "users"}), ("urn:t", "table", {"table_name": "users"}),
        ("urn:f1", "function", {"function_name": "f", "file_path": "a.py", "start_line": 1, "end_line": 2}),
        ("urn:f2", "function", {"function_name": "g", "file_path": "a.py", "start_line": 3, "end_line": 3}),
        ("urn:f3", "function", {"function_name": "h", "file_path": "gone.py", "start_line": 0, "end_line": 9}),
    ])
    src = spark.createDataFrame([("a.py", "User\ndef f():\n  return SuperUsers\ndef g(): pass\n")], "file_path string, source string")
    assert pairs(code.function_to_table(g, src), "referenced_model") == [("urn:f1", "urn:t", "User")]


@pytest.mark.parametrize("shard", [1000, 7])
def test_names_within_equals_brute_force(spark, shard):
    """One automaton, and several; names within names, blanks, letters beyond the basic plane, empty and missing texts."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab_é🙂 \n") for _ in range(n))
    texts = [(i, word(rng.randint(0, 40))) for i in range(60)] + [(60, "ab" * 50_000)]
    names = sorted({w for w in (word(rng.randint(1, 5)) for _ in range(40)) if w})
    frame = spark.createDataFrame([*texts, (61, None)], "id int, text string")
    found = code.names_within(frame, spark.createDataFrame([(n,) for n in names], "name string"), shard).collect()
    assert code.names_within(frame, spark.createDataFrame([], "name string"), shard).count() == 0
    assert sorted((r.id, r.name) for r in found) == sorted((i, n) for i, t in texts for n in names if n in t)


@pytest.mark.parametrize("shard", [1000, 1])
def test_columns_of_texts_and_names_come_along(spark, shard):
    """What was found is not joined with its text again, so nothing of it is shuffled."""
    texts = spark.createDataFrame([("f", 7, "ab bc"), ("g", None, "bc"), ("h", 1, None), ("f", 8, "none")], "id string, ord long, text string")
    names = spark.createDataFrame([("ab", "t1"), ("bc", "t2"), ("zz", "t3")], "name string, to_urn string")
    found = code.names_within(texts, names, shard)
    assert sorted(map(tuple, found.collect()), key=str) == [("f", 7, "ab", "t1"), ("f", 7, "bc", "t2"), ("g", None, "bc", "t2")]
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert code.names_within(texts, names.limit(0)).columns == found.columns == ["id", "ord", "name", "to_urn"]


def test_dockerfile_to_repo_label_beats_name(make_graph):
    g = make_graph([
        ("urn:cb1", "codebase", {"repo_name": "shop", "repo_url": "https://git.x/acme/shop.git"}), ("urn:cb2", "codebase", {"repo_name": "empty", "clone_url": "git@git.x:acme/empty.git"}),
        ("urn:df", "file", {"dockerfile_base_images": "python", "file_path": "Dockerfile"}, "urn:cb1"),
        ("urn:r1", "image_repository", {"repository_name": "acme/other"}), ("urn:i1", "image", {"oci_source": "https://git.x/Acme/shop"}, "urn:r1"),
        ("urn:r2", "image_repository", {"repository_name": "acme/shop-api"}),
        ("urn:r3", "image_repository", {"repository_name": "acme/shop"}), ("urn:i3", "image", {"oci_source": "https://git.x/acme/empty"}, "urn:r3"),
        ("urn:r4", "image_repository", {"repository_name": "acme/shop-api-web"}),
    ])
    assert pairs(containers.dockerfile_to_image_repo(g), "detection_method", "confidence") == [
        ("urn:df", "urn:r1", "oci_label", "1.0"), ("urn:df", "urn:r2", "name_heuristic", "0.8"),
    ]


def test_dockerfile_to_entrypoint(make_graph):
    g = make_graph([
        ("urn:f", "file", {"file_path": "src/main.py"}, "urn:cb"), ("urn:g", "file", {"file_path": "src/main.py"}, "urn:other"),
        ("urn:d1", "file", {"file_path": "Dockerfile", "dockerfile_entrypoint": '["python", "/app/src/main.py"]', "dockerfile_cmd": "python no.py", "dockerfile_workdir": "/app"}, "urn:cb"),
        ("urn:d2", "file", {"file_path": "d2", "dockerfile_cmd": "python $X"}, "urn:cb"),
    ])
    assert pairs(containers.dockerfile_to_entrypoint(g)) == [("urn:d1", "urn:f")]


def test_rds_and_ecs_images(make_graph):
    g = make_graph([
        ("urn:r", "rds_instance", {"rds_endpoint": "db.x"}), ("urn:d1", "database", {"host": "db.x"}), ("urn:d2", "database", {"host": "db.x"}),
        ("urn:repo", "image_repository", {"repository_uri": "acc.ecr/app"}), ("urn:td", "ecs_task_definition", {"ecs_container_images": ["acc.ecr/app:v1", "acc.ecr/app@sha256:1", "h:5000/app:v1"]}),
    ])
    assert pairs(network.rds_to_database(g)) == [("urn:r", "urn:d1")]
    assert pairs(containers.ecs_task_to_repository(g)) == [("urn:td", "urn:repo")] * 2


def test_dns_last_registration_wins(make_graph):
    g = make_graph([
        ("urn:gw", "api_gateway", {"lb_dns_name": "https://api.x", "api_gw_custom_domains": ["Shared.x."]}), ("urn:lb", "load_balancer", {"lb_dns_name": "shared.x"}),
        ("urn:dns", "dns_record", {"dns_values": ["SHARED.x", "api.x/", "nowhere"]}),
    ])
    assert pairs(network.dns_to_front_door(g)) == [("urn:dns", "urn:gw")] * 2


def test_gateway_takes_first_balancer(make_graph):
    arn = "arn:aws:elasticloadbalancing:r:1:loadbalancer/app/"
    g = make_graph([
        ("urn:l1", "load_balancer", {"arn": arn + "web/ab"}), ("urn:l2", "load_balancer", {"arn": arn + "web/abc"}), ("urn:l3", "load_balancer", {"arn": "arn:none"}),
        ("urn:gw", "api_gateway", {"api_gw_integration_uris": ["arn:x:listener/app/web/abc/1", "http://none"]}),
    ])
    assert pairs(network.gateway_to_balancer(g)) == [("urn:gw", "urn:l1")]


def test_pool_to_service(make_graph):
    g = make_graph([
        ("urn:p1", "backend_group", {"arn": "tg"}), ("urn:p2", "backend_group", {"arn": "tg"}), ("urn:s", "ecs_service", {"ecs_target_group_arns": ["tg", "x"]}), ("urn:s2", "ecs_service", {}),
    ])
    assert pairs(network.pool_to_service(g)) == [("urn:p2", "urn:s")]


def test_person_to_sso_user(make_graph):
    g = make_graph([
        ("urn:u1", "sso_user", {"sso_user_external_id": "00u1", "sso_user_email": "x@x"}), ("urn:u2", "sso_user", {"sso_user_external_id": "", "sso_user_email": "Bob@x"}),
        ("urn:p1", "person", {"person_okta_id": "00u1", "person_email": "bob@x"}), ("urn:p2", "person", {"person_okta_id": "", "person_email": "BOB@x"}), ("urn:p3", "person", {"person_email": ""}),
    ])
    assert pairs(identity.person_to_sso_user(g), "match_key", "confidence") == [("urn:p1", "urn:u1", "externalId", "1.0"), ("urn:p2", "urn:u2", "email", "0.85")]


@pytest.mark.parametrize("role_urn", ["urn:aws:iam:111::role/{}", "urn:arn:aws:iam::111:role/{}"])
def test_sso_to_iam(make_graph, role_urn):
    role = role_urn.format("AWSReservedSSO_ReadOnly_0123456789abcdef")
    g = make_graph(
        [
            ("urn:ps", "aws:permission_set", {"permission_set_name": "Read Only", "permission_set_arn": "arn:ps"}), (role, "iam_role", {"role_name": "AWSReservedSSO_ReadOnly_0123456789abcdef"}),
            ("urn:noise", "iam_role", {"role_name": "ReadOnly"}), ("urn:u", "sso_user", {}), ("urn:m", "sso_user", {}), ("urn:grp", "sso_group", {}),
        ],
        [
            ("urn:u", "urn:ps", "sso:assigned_to", {"account_id": "111"}), ("urn:u", "urn:ps", "sso:assigned_to", {"account_id": "222"}),
            ("urn:grp", "urn:ps", "sso:assigned_to", {"account_id": "111"}), ("urn:m", "urn:grp", "member_of"),
        ],
    )
    assert pairs(identity.sso_to_iam(g), "assumed_via", "via_group") == [
        ("urn:grp", role, "sso:permission_set", None), ("urn:m", role, "sso:permission_set", "urn:grp"),
        ("urn:ps", role, "iam:permission_set_role", None), ("urn:u", role, "sso:permission_set", None),
    ]


def test_role_trust(make_graph):
    allow = lambda principal, **more: {"Effect": "Allow", "Action": "sts:AssumeRole", "Principal": principal, **more}
    policies = {
        "explicit": allow({"AWS": "arn:aws:iam::1:role/src"}, Condition={"k": "v"}), "star": allow("*"), "aws_star": allow({"AWS": "*"}),
        "root": allow({"AWS": ["arn:aws:iam::123456789012:root", "arn:aws:iam::9:role/unknown"]}), "saml": allow({"Federated": "arn:aws:iam::123456789012:saml-provider/Corp"}),
        "internal": allow({"Federated": "arn:aws:iam::123456789012:saml-provider/AWSSSO_ab12_DO_NOT_DELETE"}), "oidc": allow({"Federated": "idp.x"}),
        "service": allow({"Service": "ec2.amazonaws.com"}), "denied": {**allow("*"), "Effect": "Deny"}, "self": allow({"AWS": "arn:aws:iam::1:role/self"}),
        "other": {**allow("*"), "Action": ["s3:Get*"]},
    }
    nodes = [("urn:src", "iam_role", {"arn": "arn:aws:iam::1:role/src"})]
    for i, (name, stmt) in enumerate(policies.items()):
        nodes.append((f"urn:{name}", "iam_role", {"arn": f"arn:aws:iam::1:role/{name}", "iam_trust_policy": {"Statement": [stmt] if i % 2 else stmt}}))
    edges = identity.role_trust(make_graph(nodes))
    assert pairs(edges, "assumed_via", "insecure_trust_policy") == [
        ("urn:aws:iam:123456789012::root", "urn:root", "iam:trust_policy_account_root", "account_root"),
        ("urn:aws:iam:123456789012::saml-provider/Corp", "urn:saml", "iam:trust_policy_saml", None),
        ("urn:aws:iam:federated::idp.x", "urn:oidc", "iam:trust_policy_federated", None),
        ("urn:aws:iam:wildcard::*", "urn:aws_star", "iam:trust_policy_wildcard", "wildcard"), ("urn:aws:iam:wildcard::*", "urn:star", "iam:trust_policy_wildcard", "wildcard"),
        ("urn:src", "urn:explicit", "iam:trust_policy", None),
    ]
    kept = edges.filter("to_urn = 'urn:explicit'").selectExpr("to_json(metadata.trust_policy_condition) as c").first()
    assert kept.c == '{"k":"v"}'


def test_security_group_resolver(make_graph):
    g = make_graph(
        [("urn:sg1", "security_group", {"sg_id": "sg-1"})],
        [("urn:a", "urn:aws:ec2:1:unknown/sg/sg-1", "protected_by"), ("urn:b", "urn:x:1:r:unknown/sg/sg-9", "protected_by"), ("urn:c", "urn:sg1", "protected_by")],
    )
    out = network.resolve_security_groups(g).edges
    assert pairs(out) == [("urn:a", "urn:sg1"), ("urn:b", "urn:x:1:r:unknown/sg/sg-9"), ("urn:c", "urn:sg1")]
    assert out.filter("from_urn = 'urn:a'").first().uuid != "e0"
