import uuid

import pytest
from pyspark.sql import functions as F

from palisade.functions import docker, ids, labels, scalars, source_text, urn


def column(spark, fn, values, ddl="x string"):
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    df = spark.createDataFrame(rows, ddl)
    return [r[0] for r in df.select(fn(*[F.col(c) for c in df.columns]).alias("y")).collect()]


def test_edge_ids_match_uuid5(spark):
    ns = uuid.UUID(ids.EDGE_NAMESPACE)
    got = column(spark, lambda a, b: ids.edge_id(a, b, "calls"), [("urn:a", "urn:ü"), ("urn:ü", "urn:a")], "a string, b string")
    assert got == [str(uuid.uuid5(ns, "urn:a:urn:ü:CODE_TO_CODE")), str(uuid.uuid5(ns, "urn:ü:urn:a:CODE_TO_CODE"))]
    assert got[0] != got[1]
    sso = column(spark, lambda a, b: ids.edge_id(a, b, "sso:assigned_to", F.lit("42")), [("p", "s")], "a string, b string")
    assert sso == [str(uuid.uuid5(ns, "p:s:42:SSO_ASSIGNED_TO"))]
    by_type = column(spark, lambda t: ids.edge_id(F.lit("a"), F.lit("b"), t), ["reads", "hosts"])
    assert by_type == [str(uuid.uuid5(ns, "a:b:reads")), str(uuid.uuid5(ns, "a:b:HOSTS"))]


def test_candidate_ids(spark):
    ns = uuid.UUID(ids.CANDIDATE_NAMESPACE)
    got = column(spark, lambda s, d: ids.candidate_id(s, "rule", d), [("s", None), ("s", "d")], "s string, d string")
    assert got == [str(uuid.uuid5(ns, "s:rule")), str(uuid.uuid5(ns, "s:d:rule"))]


def test_urn_parts(spark):
    arn = "urn:arn:aws:iam::123:role/x"
    plain = "urn:onprem:postgres:h:5432:db/s/t:x/c"
    assert column(spark, lambda u: urn.part(u, "path"), [arn, plain, "urn:a:b", "x:a:b:c:d:e"]) == ["123:role/x", "db/s/t:x/c", None, None]
    assert column(spark, urn.parent, [plain, "urn:a:b:c:d:root"]) == ["urn:onprem:postgres:h:5432:db/s/t:x", None]
    assert column(spark, urn.short_label, ["urn:a:b:c:d:w/x/y/z", "urn:a:b:c:d:z"]) == ["x/y/z", "z"]
    with pytest.raises(Exception, match="Invalid URN"):
        column(spark, lambda u: urn.checked_part(u, "path"), ["nope"])


def test_column_tags(spark):
    names = ["email", "email_address", "EMAIL", "password_hash", "email_token", "phone_number", "ssn", "first_name", "salary", "account_number", "created_at", "mailing"]
    got = column(spark, scalars.column_tags, names)
    assert got == [
        ["pii.email"], ["pii.email", "pii.address"], ["pii.email"], ["secret.password"], ["pii.email", "secret.token"], ["pii.phone"], ["pii.ssn"],
        ["pii.name"], ["financial.amount"], ["financial.account"], [], [],
    ]


def test_path_tags(spark):
    assert column(spark, scalars.path_tags, ["data/pii/exports/", "config/secrets/keys/", "logs/application/2024/"]) == [["pii"], ["secret"], []]


def test_comparison_keys(spark):
    urls = ["https://github.com/Acme/App.git", "git@github.com:acme/app.git", "http://github.com/acme/app/", "github.com/acme/app"]
    assert set(column(spark, scalars.repo_key, urls)) == {"github.com/acme/app"}
    assert column(spark, scalars.dns_key, ["LB.Example.com.", "https://x.example.com/"]) == ["lb.example.com", "x.example.com"]


def test_port_range_and_type_text(spark):
    ports = column(spark, scalars.port_range, [(None, None), (80, 80), (1, 9), (None, 5)], "a int, b int")
    assert ports == ["all", "80", "1-9", "None-5"]
    texts = column(
        spark, scalars.sql_type_text, [("varchar", 255, None, None), ("numeric", None, 10, 2), ("numeric", None, 10, 0), ("text", None, None, None)],
        "t string, l int, p int, s int",
    )
    assert texts == ["varchar(255)", "numeric(10,2)", "numeric(10)", "text"]


def test_index_definitions(spark):
    defs = [("CREATE UNIQUE INDEX i ON public.users (email, \"Name\")", "users"), ("CREATE INDEX i ON public.t USING gin (doc)", "t")]
    assert column(spark, lambda d, t: scalars.index_method(d), defs, "d string, t string") == ["BTREE", "GIN"]
    assert column(spark, scalars.index_columns, defs, "d string, t string") == [["email", "Name"], []]


def test_namespaces_levels_actions(spark):
    assert column(spark, labels.edge_namespace, ["okta:assigned_to", "foo:bar:baz", "contains", ""]) == ["okta", "foo", None, None]
    assert column(spark, scalars.confidence_score, ["very_high", "LOW", "none"]) == [0.95, 0.4, None]
    assert column(spark, lambda t: scalars.action_type(t, F.array(F.lit("x_last_evaluated_at"))), ["mcp__knowledge__update_node_metadata", "mcp__a__b", "Bash"]) == [
        "EVALUATED_AT_MARKED", "MCP_TOOL_CALL", "UNKNOWN",
    ]


def test_docker_targets(spark):
    cases = {
        '["python", "src/main.py"]': "src/main.py", "python src/main.py": "src/main.py", '["uvicorn", "app.main:app"]': "app/main.py",
        "uv run uvicorn app.main:app": "app/main.py", "python $MAIN": None, '["python"]': None, "/usr/bin/python3 -u /srv/x.py": "/srv/x.py", '["bad': '["bad',
    }
    assert column(spark, docker.target_file, list(cases)) == list(cases.values())


def test_docker_paths(spark):
    rows = [("/app/src/x.py", "/app", []), ("/srv/x.py", None, ["/srv"]), ("/x.py", None, ["/"]), ("x.py", "/app", []), ("/app", "/app/", [])]
    assert column(spark, docker.repo_path, rows, "f string, w string, c array<string>") == ["src/x.py", "x.py", "x.py", "x.py", ""]


def test_dockerfile_final_stage(spark):
    text = "FROM golang:1 AS b\nENTRYPOINT [\"no\"]\nFROM --platform=x python:3\nWORKDIR /a\nWORKDIR /b\nCOPY --from=b x /y\nCMD python m.py\n"
    assert column(spark, docker.base_images, [text]) == [["golang:1", "python:3"]]
    assert column(spark, docker.entrypoint, [text]) == [None]
    assert column(spark, docker.cmd, [text]) == ["python m.py"]
    assert column(spark, docker.workdir, [text, "FROM x"]) == ["/b", None]
    assert column(spark, docker.copy_targets, [text]) == [["/y"]]


def test_source_text(spark):
    assert column(spark, lambda s: source_text.lines_between(s, F.lit(1), F.lit(2)), ["a\nb\r\nc\n"]) == ["b\nc"]
    assert column(spark, source_text.s3_operations, ['c.put_object(1); c.get_paginator("list_objects_v2")', "x"]) == ["list_objects_v2,put_object", None]
    assert column(spark, source_text.orm_operations, ["s.query(A).filter(x).delete()", "s.add_all([])"]) == ["delete,query", "add_all"]
    assert column(spark, source_text.orm_operation_types, ["delete,query", "add_all"]) == ["delete,read", "write"]
    assert [tuple(r) if r else None for r in column(spark, source_text.flask_route, ['@bp.route("/x", methods=["get", "POST"])', "@x.get()"])] == [("/x", "GET,POST"), None]
    assert [tuple(r) if r else None for r in column(spark, source_text.stdlib_io, ["os.getenv('X'); s.connect()", "pass"])] == [("ingress", "env"), None]
    assert column(spark, lambda s: source_text.imports(s, "boto3"), ["import os\nimport boto3", "import boto3x", "from boto3.s3 import x"]) == [True, False, True]
