import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from palisade.model import DuplicateNodeError, Graph
from palisade.operators import compliance, enrich, legality, mutate, rules, search, security, soft_links
from palisade.operators.adjacency import write_links
from palisade.plans import scan
from palisade.session import SMALL, small_partitions, stash
from palisade.sources import graph_json, plugins
from palisade.sources.dispatch import Target, chosen_plugins, load_target
from palisade.sources.store import ParquetStore, report, with_status
from palisade.streaming.refresh import follow


def values(nodes, *keys):
    from palisade.functions import meta

    return {r[0]: tuple(r)[1:] for r in nodes.select("urn", *[meta.text(nodes, k).alias(k) for k in keys]).collect()}


@pytest.fixture
def small(make_graph):
    return make_graph(
        [("urn:t", "table", {"table_name": "users", "data_sensitivity": "custom.tag"}), ("urn:c", "column", {"column_name": "email"}, "urn:t"), ("urn:f", "unknown", {"function_name": "f", "mystery": {"a": 1}})],
        [("urn:f", "urn:t", "reads", {"confidence": 0.9})],
    )


def test_enrichment_merges_with_existing_tags(small):
    out = enrich.enrich_sensitivity(small.nodes)
    assert values(out, "data_sensitivity") == {"urn:t": ("custom.tag,pii.email",), "urn:c": ("pii.email",), "urn:f": (None,)}


def test_update_and_delete_metadata(small):
    nodes = mutate.update_node_metadata(small.nodes, "urn:f", json.dumps({"http_method": "GET", "mystery": [2], "new_key": "v", "function_name": None}))
    assert values(nodes, "http_method", "function_name", "new_key", "mystery")["urn:f"] == ("GET", None, "v", "[2]")
    assert values(nodes, "table_name")["urn:t"] == ("users",)
    gone = mutate.delete_node_metadata(nodes, "urn:f", "new_key", "http_method", "never_there")
    assert values(gone, "http_method", "new_key", "mystery")["urn:f"] == (None, None, "[2]")
    with pytest.raises(mutate.BadPatchError):
        mutate.update_node_metadata(small.nodes, "urn:f", "[1]")
    with pytest.raises(mutate.BadPatchError):
        mutate.update_node_metadata(small.nodes, "urn:f", "{")
    with pytest.raises(KeyError):
        mutate.update_node_metadata(small.nodes, "urn:none", "{}")


def test_patch_log_last_write_per_key_wins(small, spark):
    log = spark.createDataFrame([("urn:f", 2, '{"io_type": "b"}'), ("urn:f", 1, '{"io_type": "a", "size_bytes": 7}')], "urn string, seq bigint, patch string")
    nodes = mutate.apply_patches(small.nodes, mutate.merged_patches(log), ["io_type", "size_bytes"])
    assert values(nodes, "io_type", "size_bytes")["urn:f"] == ("b", "7")


def test_soft_links(small, spark):
    ask = spark.createDataFrame(
        [("urn:f", "urn:t", None, None, "n", "2024-01-01"), ("urn:f", "urn:nope", "reads", "LOW", "", ""), ("urn:f", "urn:t", "hosts", "LOW", "", ""), ("urn:f", "urn:t", "reads", "SURE", "", ""),
         ("urn:f", "urn:t", "reads", "high", "", "")],
        "from_urn string, to_urn string, edge_type string, confidence_level string, note string, created_at string",
    )
    errors = sorted((r.error or "ok").split(":")[0] for r in soft_links.check_links(small, ask).collect())
    assert errors == ["invalid confidence", "invalid edge_type", "ok", "ok", "to_urn not found in graph"]
    linked = soft_links.add_soft_links(small, ask)
    assert sorted((r.edge_type, r.confidence) for r in linked.soft_links.collect()) == [("reads", 0.8), ("soft_reference", 0.6)]
    again = soft_links.check_links(linked, ask).filter("error like 'soft link already%'")
    assert again.count() == 2
    full = soft_links.with_link_edges(linked)
    assert full.edges.count() == 3
    gone = soft_links.remove_soft_links(linked, linked.soft_links.filter("edge_type = 'reads'"))
    left = soft_links.with_link_edges(gone).edges
    assert left.filter("edge_type = 'reads'").count() == 1  # the scanned edge stays
    assert [(r.from_label, r.to_label) for r in soft_links.list_soft_links(gone).collect()] == [("f", "users")]


def test_settled_edges_keep_the_last(small):
    edges = small.edges
    later = edges.withColumns({"ord": F.lit(9).cast("bigint"), "metadata": F.struct(F.lit(0.1).alias("confidence"))})
    out = search.settle_edges(edges.unionByName(later, allowMissingColumns=True))
    assert [r.metadata.confidence for r in out.collect()] == [0.1]


def test_documents_round_trip(small, tmp_path, spark):
    links = soft_links.accept_links(soft_links.check_links(small, spark.createDataFrame([("urn:f", "urn:t", "calls", "LOW", 'a "note"', "2024")], "from_urn string, to_urn string, edge_type string, confidence_level string, note string, created_at string")))
    graph = Graph(small.nodes, small.edges, links)
    graph_json.write_document(graph, str(tmp_path / "doc"), "2024-01-01")
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*")))
    doc = json.loads(text)
    assert (doc["node_count"], doc["edge_count"], len(doc["soft_links"])) == (3, 1, 1)
    assert {n["urn"]: n["node_type"] for n in doc["nodes"]}["urn:f"] == "function"
    assert [n["metadata"] for n in doc["nodes"] if n["urn"] == "urn:f"] == [{"function_name": "f", "mystery": {"a": 1}}]
    path = tmp_path / "graph.json"
    path.write_text(json.dumps(doc, indent=2))
    graph_json.write_lines(graph, str(tmp_path / "lines"))
    loaded = [graph_json.load_document(spark, str(path)), graph_json.load_indented(spark, str(path)), graph_json.load_lines(spark, str(tmp_path / "lines"))]
    for g in loaded:
        assert values(g.nodes, "table_name", "column_name", "function_name", "mystery") == {
            "urn:t": ("users", None, None, None), "urn:c": (None, "email", None, None), "urn:f": (None, None, "f", '{"a":1}'),
        }
        assert [r.metadata.confidence for r in g.edges.collect()] == [0.9]
        assert g.soft_links.count() == 1
        assert [r.urn for r in g.nodes.orderBy("ord").collect()] == ["urn:t", "urn:c", "urn:f"]


def test_store_keeps_versions_and_links(small, tmp_path, spark):
    store = ParquetStore(spark, str(tmp_path / "store"))
    assert store.latest() is None
    links = soft_links.accept_links(soft_links.check_links(small, spark.createDataFrame([("urn:f", "urn:t", "calls", "LOW", "", "")], "from_urn string, to_urn string, edge_type string, confidence_level string, note string, created_at string")))
    first = store.write(Graph(small.nodes, small.edges, links))
    second = store.write(Graph(small.nodes.filter("urn <> 'urn:c'"), small.edges))
    assert store.latest() == second and second > first
    assert store.read(first).nodes.count() == 3 and store.read().nodes.count() == 2
    assert store.read().soft_links.count() == 1  # a re-scan does not lose them
    plan = store.read().of_type("function")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(node_type" in plan


ASK = "from_urn string, to_urn string, edge_type string, confidence_level string, note string, created_at string"


def test_store_merges_changes_on_read(small, tmp_path, spark):
    store = ParquetStore(spark, str(tmp_path / "store"))
    first = store.write(small)
    log = [("urn:f", 2, '{"io_type": "b", "odd": 1}'), ("urn:f", 1, '{"io_type": "a", "size_bytes": 7, "function_name": null}'), ("urn:none", 1, '{"io_type": "x"}')]
    patched = store.update_node_metadata(spark.createDataFrame(log, "urn string, seq int, patch string"))
    assert values(store.read().nodes, "io_type", "size_bytes", "odd", "mystery", "function_name")["urn:f"] == ("b", "7", "1", '{"a":1}', None)
    dropped = store.delete_node_metadata(spark.createDataFrame([("urn:f", "odd"), ("urn:f", "io_type"), ("urn:t", "never")], "urn string, key string"))
    assert values(store.read().nodes, "io_type", "size_bytes", "odd", "mystery")["urn:f"] == (None, "7", None, '{"a":1}')
    again = store.update_node_metadata(spark.createDataFrame([("urn:f", 0, '{"io_type": "c"}')], "urn string, seq int, patch string"))
    linked = store.add_soft_links(spark.createDataFrame([("urn:f", "urn:t", "calls", "LOW", "", ""), ("urn:f", "urn:no", "calls", "LOW", "", ""), ("urn:f", "urn:c", "reads", None, "", "")], ASK))
    links = {r.edge_type: r.id for r in store.read().soft_links.collect()}
    assert set(links) == {"calls", "reads"}
    removed = store.remove_soft_links(spark.createDataFrame([(links["calls"],), ("unknown",)], "id string"))
    assert [r.edge_type for r in store.read().soft_links.collect()] == ["reads"]
    store.add_soft_links(spark.createDataFrame([("urn:f", "urn:t", "calls", "HIGH", "", "")], ASK))
    # every version stays as it was
    states = [(v, values(store.read(v).nodes, "io_type", "odd")["urn:f"], store.read(v).soft_links.count()) for v in (first, patched, dropped, again, linked, removed)]
    assert [s[1:] for s in states] == [((None, None), 0), (("b", "1"), 0), ((None, None), 0), (("c", None), 0), (("c", None), 2), (("c", None), 1)]
    assert store.compact(9) == store.latest()
    before = sorted(map(str, store.read().soft_links.collect())), values(store.read().nodes, "io_type", "size_bytes", "mystery")
    base = store.compact(2)
    assert base == store.latest() and (sorted(map(str, store.read().soft_links.collect())), values(store.read().nodes, "io_type", "size_bytes", "mystery")) == before
    assert store.read(removed).soft_links.count() == 1 and store._state(None)[2] == []
    with pytest.raises(FileNotFoundError):
        store.read("no such version")


def test_streamed_patches_become_a_version(small, tmp_path, spark):
    store = ParquetStore(spark, str(tmp_path / "store"))
    before = store.write(small)
    log = tmp_path / "log"
    log.mkdir()
    (log / "1.json").write_text('{"urn": "urn:f", "seq": 1, "patch": "{\\"io_type\\": \\"env\\"}"}\n')
    query = follow(spark, store, str(log), str(tmp_path / "ckpt"))
    query.awaitTermination(120)
    assert store.latest() != before
    assert values(store.read().nodes, "io_type")["urn:f"] == ("env",)


def test_rules_and_marks(make_graph):
    g = make_graph(
        [
            ("urn:f1", "function", {"http_method": "GET", "insecure_endpoint_last_evaluated_at": "x"}), ("urn:f2", "function", {"http_method": "GET"}),
            ("urn:f3", "function", {"http_method": "GET", "auth_scheme": ""}), ("urn:d", "dependency", {"cve_ids": "CVE-1"}),
            ("urn:e", "file", {"dockerfile_cmd": "x", "dockerfile_base_images": "y"}), ("urn:e2", "file", {"dockerfile_cmd": "x"}), ("urn:r", "image_repository", {}),
        ],
        [("urn:e", "urn:f1", "executes"), ("urn:f2", "urn:d", "depends_on")],
    )
    found = rules.gather(g)
    assert sorted((r.heuristic_name, r.source_urn) for r in found.collect()) == [
        ("insecure_endpoint", "urn:f1"), ("insecure_endpoint", "urn:f2"), ("orphaned_ecr_repo", "urn:r"), ("unlinked_dockerfile", "urn:e"),
        ("unlinked_entrypoint", "urn:e2"), ("vulnerable_dependency", "urn:d"),
    ]
    left = rules.drop_evaluated(found, g, ["insecure_endpoint"])
    assert left.count() == 5
    linked = rules.Rule("near", "function", {"http_method": True}, dest_node_type="dependency")
    assert [(r.source_urn, r.path) for r in rules.find(g, linked).collect()] == [("urn:f2", ["urn:f2", "urn:d"])]
    assert rules.Rule.from_dict(linked.to_dict()) == linked
    updates = found.limit(1).select("id", F.lit(1).alias("seq"), F.lit("completed").alias("status"))
    assert with_status(found, updates).filter("status = 'completed'").count() == 1
    assert report(found.select(F.lit("linked").alias("outcome"))).first().n == 6


def test_compliance_chain(spark):
    people = spark.createDataFrame([(1, "a"), (2, "b")], "id int, mail string")
    orders = spark.createDataFrame([(10, 1, "x"), (11, 2, "y"), (12, None, "z")], "oid int, person int, region string")
    items = spark.createDataFrame([(10, "x", 5), (10, "y", 6), (11, "y", 7)], "oid int, region string, n int")
    chosen = compliance.select_sentinel(people, ["mail"], "a")
    own = compliance.follow_key(orders, chosen, ["person"], ["id"])
    lines = compliance.follow_key(items, own, ["oid", "region"], ["oid", "region"])
    assert [r.n for r in lines.collect()] == [5]
    assert sorted(r.oid for r in compliance.survivors(orders, own, ["oid"]).collect()) == [11, 12]
    assert compliance.outcome(own).first().rows_affected == 1


def test_legality_report(make_graph):
    g = make_graph([("urn:t", "table", {}), ("urn:r", "image_repository", {}), ("urn:u", "unknown", {})], [("urn:t", "urn:r", "references"), ("urn:u", "urn:t", "reads"), ("urn:t", "urn:gone", "contains")])
    assert sorted((r.side, r.node_type) for r in legality.violations(g).collect()) == [("incoming", "image_repository"), ("outgoing", "table")]


def test_duplicate_nodes_abort(make_graph):
    with pytest.raises(DuplicateNodeError, match="urn:x"):
        make_graph([("urn:x", "table", {}), ("urn:x", "table", {})]).validate()
    make_graph([("urn:x", "table", {})]).validate()


def test_dispatch_names_known_schemes(spark):
    with pytest.raises(ValueError, match="known schemes: .*aws:account"):
        load_target(spark, Target("urn:nope:x:::y", "/nowhere"))
    assert chosen_plugins("manual", ["ecr"]) == [] and chosen_plugins("all", [], ["iam"]) == ["iam"] and chosen_plugins("relevant", ["ecr"]) == ["ecr"]


def test_plugins_of_a_tree(spark, tmp_path):
    (tmp_path / "a.py").write_text("import click\n")
    (tmp_path / "uv.lock").write_text('[[package]]\nname = "click"\nversion = "8"\n')
    ran = []

    def extend(tree, graph):
        ran.append(tree.scan.urn)
        return graph

    types = lambda **more: {r.node_type for r in load_target(spark, Target("urn:_:repo:_:_:/x/app", str(tmp_path), **more)).nodes.select("node_type").distinct().collect()}
    try:
        plugins.register_code_plugin(plugins.CodePlugin("rusty", extend, frozenset({"rust"})))
        plugins.register_code_plugin(plugins.CodePlugin("pythonic", extend, frozenset({"python"}), frozenset({"setup.cfg"})))
        assert "dependency" in types() and ran == ["urn:local:codebase:_:_:app"]  # no Rust there
        assert "dependency" in types(mode="relevant") and len(ran) == 1
        assert types(mode="manual") == {"codebase", "file"} and len(ran) == 1
        assert types(mode="manual", plugins=("pythonic", "rusty")) == {"codebase", "file"} and len(ran) == 2
        with pytest.raises(ValueError, match="known: pythonic, rusty, uv"):
            types(plugins=("nope",))
        with pytest.raises(ValueError, match="mode"):
            types(mode="some")
    finally:
        for name in ("rusty", "pythonic"):
            plugins.CODE_PLUGINS.pop(name, None)


def test_scan_end_to_end(spark, tmp_path):
    repo = tmp_path / "shop"
    (repo / "node_modules").mkdir(parents=True)
    (repo / "node_modules" / "x.py").write_text("def no(): pass\n")
    (repo / "models.py").write_text("from sqlalchemy import Column\n\nclass User(Base):\n    __tablename__ = 'users'\n")
    (repo / "main.py").write_text("from shop.models import User\nfrom flask import Flask\n\n@app.route('/x', methods=['POST'])\ndef view():\n    return User()\n\ndef view():\n    return view()\n")
    (repo / "Dockerfile").write_text("FROM python:3\nCMD python main.py\n")
    (repo / "broken.py").write_text("def (:\n")
    (repo / "lib.rs").write_text("use crate::util::{help as h, other};\nstruct Pool { n: i32 }\nimpl Pool {\n    fn new() -> Pool { h(); Pool { n: 1 } }\n}\nfn run() { crate::util::other(); assert!(run()); x.method(); }\n")
    (repo / "util.rs").write_text("pub fn help() {}\npub fn other() { missing::gone(); }\n")
    aws = tmp_path / "aws"
    aws.mkdir()
    (aws / "buckets.json").write_text('{"Name": "b1", "LocationConstraint": null}\n{"Name": "b2", "LocationConstraint": "eu-west-1"}\n')
    store = ParquetStore(spark, str(tmp_path / "graph"))
    version = scan.scan(spark, [Target("urn:_:repo:_:_:" + str(repo), str(repo)), Target("urn:aws:account:1:us-east-1:root", str(aws))], store)
    g = store.read(version)
    base = "urn:local:codebase:_:_:shop"
    kinds = {r.urn.replace(base, ""): r.node_type for r in g.nodes.collect()}
    assert kinds["/main.py/view"] == kinds["/main.py/view__2"] == kinds["/lib.rs/new"] == "function" and kinds["/lib.rs/Pool"] == kinds["/models.py/User"] == "class"
    assert kinds["urn:arn:aws:s3:::b1"] == "s3_bucket" and "urn:arn:aws:s3:::b2" not in kinds and kinds["/broken.py"] == "file" and not any("node_modules" in k for k in kinds)
    links = {(r.from_urn.replace(base, ""), r.to_urn.replace(base, ""), r.edge_type) for r in g.edges.filter("edge_type <> 'contains'").collect()}
    assert links == {
        ("/main.py/view", "/models.py/User", "instantiates"), ("/main.py/view__2", "/main.py/view__2", "calls"), ("/Dockerfile", "/main.py", "executes"),
        ("/lib.rs/new", "/util.rs/help", "calls"), ("/lib.rs/run", "/util.rs/other", "calls"),
    }
    tags = values(g.nodes, "http_method", "route_path", "orm_table")
    assert tags[base + "/main.py/view"] == ("POST", "/x", None) and tags[base + "/models.py/User"] == (None, None, "users")


def test_clone_urls_and_commits(tmp_path):
    from palisade.sources.code import head_commit
    from palisade.sources.dispatch import _host_and_path

    assert _host_and_path("https://user:x@Git.Example.com:8443/acme/shop.git") == ("git.example.com", "acme/shop")
    assert _host_and_path("git@git.example.com:acme/shop.git") == ("git.example.com", "acme/shop")
    assert _host_and_path("ssh://git@git.example.com/acme/shop/") == ("git.example.com", "acme/shop")
    assert _host_and_path("/src/shop") == ("unknown", "src/shop")
    assert head_commit(str(tmp_path)) is None
    git = tmp_path / ".git"
    (git / "refs" / "heads").mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/a\n")
    assert head_commit(str(tmp_path)) is None
    (git / "packed-refs").write_text("# x\n^0\nabc refs/heads/a\n")
    assert head_commit(str(tmp_path)) == "abc"
    (git / "refs" / "heads" / "a").write_text("def\n")
    assert head_commit(str(tmp_path)) == "def"
    (git / "HEAD").write_text("123\n")
    assert head_commit(str(tmp_path)) == "123"


def test_scan_reads_locks_imports_and_source_texts(spark, tmp_path):
    lock = '''[[package]]
name = "flask"
version = "3.0"
dependencies = [{ name = "click", version = "8.1", marker = "a" }, { name = "click", version = "8.1", marker = "b" }]
[[package]]
name = "click"
version = "8.1"
[[package]]
name = "click"
version = "8.0"
'''
    for name, body in (("shop", "    return session.query(User)\n"), ("other", "    return 1\n\n\n")):
        repo = tmp_path / name
        (repo / "node_modules").mkdir(parents=True)
        (repo / "main.py").write_text("from flask import Flask\nimport click\nimport os\n\ndef view(session):\n" + body)
    (tmp_path / "shop" / "models.py").write_text("from sqlalchemy import Column\n\nclass User(Base):\n    __tablename__ = 'users'\n")
    (tmp_path / "shop" / "uv.lock").write_text(lock)
    (tmp_path / "shop" / "node_modules" / "uv.lock").write_text(lock.replace("flask", "hidden"))
    db = tmp_path / "db"
    frames = {
        "schemata": [("public",)], "tables": [("public", "users", "BASE TABLE")], "columns": [], "foreign_keys": [], "roles": [], "grants": [],
    }
    ddl = {
        "schemata": "schema_name string", "tables": "table_schema string, table_name string, table_type string",
        "columns": "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable boolean, character_maximum_length int, numeric_precision int, numeric_scale int",
        "foreign_keys": "constraint_name string, fk_schema string, fk_table string, fk_column string, ref_schema string, ref_table string, ref_column string, ordinal_position int",
        "roles": "role_name string, can_login boolean, is_superuser boolean",
        "grants": "grantee string, table_schema string, table_name string, privilege_type string, is_grantable boolean",
    }
    for name, rows in frames.items():
        spark.createDataFrame(rows, ddl[name]).write.parquet(str(db / name))
    store = ParquetStore(spark, str(tmp_path / "graph"))
    known = tmp_path / "osv.json"
    known.write_text('{"name": "click", "version": "8.0", "vulns": [{"id": "GHSA-1", "aliases": ["CVE-2"]}]}\n{"name": "click", "version": "7", "vulns": [{"id": "CVE-7"}]}\n')
    targets = [Target(f"urn:_:repo:_:_:{tmp_path / n}", str(tmp_path / n), vulnerabilities=str(known)) for n in ("shop", "other")] + [Target("urn:onprem:postgres:h:5432:shop", str(db))]
    g = store.read(scan.scan(spark, targets, store))
    base = "urn:local:codebase:_:_:shop"
    assert values(g.nodes.filter("node_type = 'dependency'"), "package_version", "cve_ids") == {
        base + "/dep/flask": ("3.0", None), base + "/dep/click@8.0": ("8.0", "CVE-2"), base + "/dep/click@8.1": ("8.1", None),
    }
    links = sorted((r.from_urn.replace(base, ""), r.to_urn.replace(base, "")) for r in g.edges_of("depends_on").collect())
    assert links == [
        ("/dep/flask", "/dep/click@8.1"), ("/main.py", "/dep/click@8.0"), ("/main.py", "/dep/click@8.1"), ("/main.py", "/dep/flask"),
        ("/uv.lock", "/dep/click@8.0"), ("/uv.lock", "/dep/click@8.1"), ("/uv.lock", "/dep/flask"),
    ]
    assert [r.source_urn for r in rules.gather(g, ["vulnerable_dependency"]).collect()] == [base + "/dep/click@8.0"]
    assert sorted((r.version, r.cve_ids, r.file_path.replace(base, "")) for r in security.find_vulnerable_code(g).collect()) == [("8.0", "CVE-2", "/uv.lock"), ("8.0", "CVE-2", "main.py")]
    assert [(r.from_urn, r.to_urn.rsplit("/", 1)[-1]) for r in g.edges_of("reads").collect()] == [(base + "/main.py/view", "users")]


def test_ends_that_are_nodes_need_no_edges(small, spark):
    broken = small.edges.withColumn("from_urn", F.when(F.col("to_urn").isNotNull(), F.raise_error(F.lit("edges were read")).cast("string")))
    ask = spark.createDataFrame([("urn:f", "urn:t"), ("urn:f", None)], "from_urn string, to_urn string")
    assert sorted(r.urn for r in soft_links.known_urns(Graph(small.nodes, broken), ask).collect()) == ["urn:f", "urn:t"]
    ends = spark.createDataFrame([("urn:bare", "urn:f"), ("urn:f", "urn:bare")], "from_urn string, to_urn string")
    ask = spark.createDataFrame([("urn:f", "urn:bare"), ("urn:bare", "urn:no")], "from_urn string, to_urn string")
    assert sorted(r.urn for r in soft_links.known_urns(Graph(small.nodes, ends), ask).collect()) == ["urn:bare", "urn:f"]


def test_legality_shuffles_an_end_and_the_other_one(make_graph):
    g = make_graph([("urn:a", "table", {}), ("urn:b", "function", {})], [("urn:a", "urn:b", "calls"), ("urn:b", "urn:a", "reads"), ("urn:b", "urn:b", "contains")])
    found = legality.violations(g)
    assert "other" in found._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted((r.from_urn, r.to_urn, r.edge_type, r.side) for r in found.collect())
    assert rows == [("urn:a", "urn:b", "calls", "outgoing"), ("urn:b", "urn:b", "contains", "outgoing")]


def test_a_store_sorts_its_rows_where_they_are_computed(spark, make_graph, tmp_path):
    """Nothing is dealt anew: each job that writes nodes, edges or links has one stage, and every file is sorted by its key."""
    g = make_graph([(f"urn:{i}", "x", {}) for i in range(60)], [(f"urn:{i % 7}", f"urn:{i * 31 % 60}", "reads") for i in range(60)])
    g = Graph(g.nodes.repartition(3), g.edges.repartition(3))
    g = Graph(stash(g.nodes, "nodes"), stash(g.edges, "edges"))
    sc = spark.sparkContext
    sc.setJobGroup("written", "")
    ParquetStore._write_sorted(g.nodes, "node_type", "urn", str(tmp_path / "nodes"))
    ParquetStore._write_sorted(g.edges, "edge_type", "from_urn", str(tmp_path / "edges"))
    write_links(g.edges, str(tmp_path / "links"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("written")]
    assert [len(j.stageIds) for j in jobs] == [1, 1, 1]
    for place, key, n in (("nodes", "urn", 60), ("edges", "from_urn", 60), ("links", "src", 120)):
        files = [pq.read_table(str(p), partitioning=None)[key].to_pylist() for p in (tmp_path / place).rglob("*.parquet")]
        assert sum(map(len, files)) == n and all(f == sorted(f) for f in files)


def test_sizes_of_partitions_are_put_back(spark):
    advisory, files = SMALL
    before = spark.conf.get(files)
    spark.conf.set(advisory, "3m")
    try:
        with pytest.raises(ZeroDivisionError), small_partitions(spark):
            assert (spark.conf.get(advisory), spark.conf.get(files)) == ("3m", SMALL[files])
            raise ZeroDivisionError
        assert (spark.conf.get(advisory), spark.conf.get(files), spark.conf.get(files, None)) == ("3m", before, None)
    finally:
        spark.conf.unset(advisory)
