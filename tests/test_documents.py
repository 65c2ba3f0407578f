"""Documents read by byte ranges against the whole read at once."""

import bz2
import gzip
import json
import random
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions import meta
from palisade.session import stash
from palisade.sources import graph_json
from palisade.sources.json_ranges import Unpacked, elements

CHANCE = random.Random(9)
NASTY = ['a "quoted" one', "back\\slash\\\\", '\\"', "{[}]", "é🙂", '": [{', "\\" * 9, "line\nbreak", ""]


def document(n):
    text = lambda: CHANCE.choice(NASTY) + CHANCE.choice(NASTY)
    node = lambda i: {"urn": f"urn:n{i}", "organization_id": "o", "parent_urn": None, "node_type": "function", "metadata": {"function_name": text(), "deep": {"a": [{"b": text()}, []]}}}
    edge = lambda i: {"uuid": f"e{i}", "organization_id": "o", "from_urn": f"urn:n{i}", "to_urn": "urn:n0", "edge_type": "calls", "metadata": {"note": text()}}
    return {
        "generated_at": text(), "meta": {"nodes": [{"urn": "not one"}], "x": {"y": {}}}, "nodes": [node(i) for i in range(n)],
        "edges": [edge(i) for i in range(n)], "soft_links": [{"id": "l", "from_urn": "urn:n0", "to_urn": "urn:n1", "edge_type": "calls", "note": text()}], "more": [[{"z": 1}], 3],
    }


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", [37, 1000])
def test_elements_of_any_layout(spark, tmp_path, indent, size):
    doc = document(12)
    path = tmp_path / "graph.json"
    path.write_text(json.dumps(doc, indent=indent, ensure_ascii=bool(size % 2)))
    rows = elements(spark, str(path), size).orderBy("place").collect()
    assert [r.text for r in rows if r.kind == "list"] == ["meta", "nodes", "edges", "soft_links", "more"]
    found = [json.loads(r.text) for r in rows if r.kind == "element"]
    inner = [{"urn": "not one"}]  # elements of the object in ``meta`` are lists and objects at that depth
    assert [x for x in found if isinstance(x, dict) and ("uuid" in x or "id" in x or str(x.get("urn", "")).startswith("urn:"))] == doc["nodes"] + doc["edges"] + doc["soft_links"]
    assert inner in found or inner[0] in found


def test_loaded_document_in_one_file_and_in_parts(spark, tmp_path):
    doc = document(30)
    path = tmp_path / "graph.json"
    path.write_text(json.dumps(doc))
    g = graph_json.load_document(spark, str(path), 500)
    names = {r.urn: r.f for r in g.nodes.select("urn", meta.get(g.nodes, "function_name").alias("f")).collect()}
    assert names == {n["urn"]: n["metadata"]["function_name"] for n in doc["nodes"]}
    assert [r.urn for r in g.nodes.orderBy("ord").collect()] == [n["urn"] for n in doc["nodes"]]
    assert g.edges.count() == 30 and [r.note for r in g.soft_links.collect()] == [doc["soft_links"][0]["note"]]
    graph_json.write_document(g, str(tmp_path / "parts"), "2024")
    again = graph_json.load_document(spark, str(tmp_path / "parts"), 700)
    assert {r.urn: r.f for r in again.nodes.select("urn", meta.get(again.nodes, "function_name").alias("f")).collect()} == names
    assert again.edges.count() == 30 and again.soft_links.count() == 1


def test_documents_without_lists(spark, tmp_path):
    for text in ("{}", '{"nodes": [], "edges": []}', '{"nodes": [{"urn": "urn:a"'):
        path = tmp_path / "graph.json"
        path.write_text(text)
        g = graph_json.load_document(spark, str(path), 5)
        assert (g.nodes.count(), g.edges.count(), g.soft_links.count()) == (0, 0, 0)


def test_a_document_is_read_without_a_copy_of_its_elements(tmp_path, spark, monkeypatch):
    kept = []
    monkeypatch.setattr(graph_json, "stash", lambda df, label: kept.append(df.columns) or stash(df, label))
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"urn": f"urn:{i}", "node_type": "x", "metadata": {}} for i in range(40)], "edges": [{"uuid": "e", "from_urn": "urn:1", "to_urn": "urn:2", "edge_type": "reads", "metadata": {}}]}))
    graph = graph_json.load_document(spark, str(tmp_path / "g.json"), 64)
    assert (graph.nodes.count(), graph.edges.count()) == (40, 1)
    assert kept and all("text" not in columns for columns in kept)


@pytest.mark.parametrize("size", [37, 1000, 1 << 20])
def test_compressed_documents_are_read_as_their_text(spark, tmp_path, size):
    doc = document(12)
    text = json.dumps(doc, ensure_ascii=False).encode()
    (tmp_path / "g.json").write_bytes(text)
    # several members, torn inside an element
    (tmp_path / "g.json.gz").write_bytes(b"".join(gzip.compress(text[i : i + 1001]) for i in range(0, len(text), 1001)))
    (tmp_path / "g.json.bz2").write_bytes(bz2.compress(text))
    want = [tuple(r) for r in elements(spark, str(tmp_path / "g.json"), size).orderBy("place").collect()]
    for name in ("g.json.gz", "g.json.bz2"):
        assert [tuple(r) for r in elements(spark, str(tmp_path / name), size).orderBy("place").collect()] == want


def test_unpacked_text_goes_forward_and_back(tmp_path):
    text = bytes(CHANCE.randrange(256) for _ in range(50_000)) * 60
    (tmp_path / "x.gz").write_bytes(gzip.compress(text, 1))
    with Unpacked(str(tmp_path / "x.gz"), "gzip", 1000) as file:
        for start, n in [(0, 10), (5, 2_000_000), (1_999_900, 300), (100, 50), (2_999_990, 100), (3_000_000, 5), (9, 0)]:
            file.seek(start)
            assert file.read(n) == text[start : start + n]
            assert len(file.held) <= n + (2 << 20)


def test_parts_are_one_compressed_document_in_order(make_graph, spark, tmp_path):
    """Ids that are UUIDs travel as 16 bytes; others, missing ones and edges that come twice are written too, each with its comma."""
    ids = ["0b0d6c2c-6a0e-5b6f-9d6a-1c7e2f4b8a90", "0b0d6c2c-6a0e-5b6f-9d6a-1c7e2f4b8a91", "0B0D6C2C-6A0E-5B6F-9D6A-1C7E2F4B8A90", 'no "uuid"\n', "0b0d6c2c-6a0e-5b6f-9d6a-1c7e2f4b8a90\n", None]
    g = make_graph([("urn:a", "x", {}), ("urn:b", "x", {"mystery": 1})], [("urn:a", "urn:b", "reads", {"note": "n"})])
    with_ids = [g.edges.withColumns({"uuid": F.lit(u), "ord": F.lit(k % 2).cast("bigint")}) for k, u in enumerate([*ids, ids[1]])]
    g = g.with_edges(reduce(DataFrame.unionAll, with_ids))
    for name, more in (("plain", ()), ("packed", ("gzip",))):
        graph_json.write_document(g, str(tmp_path / name), "2024", *more)
    plain = b"".join(p.read_bytes() for p in sorted((tmp_path / "plain").glob("part-*")))
    packed = sorted((tmp_path / "packed").glob("part-*.gz"))
    assert gzip.decompress(b"".join(p.read_bytes() for p in packed)) == plain
    doc = json.loads(plain)
    key = lambda k, u: (k % 2, "|".join([*([u] if u is not None else []), "urn:a"]))
    assert [e.get("uuid") for e in doc["edges"]] == [u for _, u in sorted(((key(k, u), u) for k, u in enumerate([*ids, ids[1]])), key=lambda x: x[0])]
    assert (doc["node_count"], doc["edge_count"], doc["soft_links"]) == (2, 7, [])
    assert all(e["metadata"] == {"note": "n"} and e["edge_type"] == "reads" for e in doc["edges"])
    back = graph_json.load_document(spark, str(tmp_path / "packed"), 100)
    assert [r.uuid for r in back.edges.orderBy("ord").collect()] == [e.get("uuid") for e in doc["edges"]]


def test_a_graph_is_computed_once_for_its_document(make_graph, spark, tmp_path):
    rows = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(urn):
        rows.add(1)
        return urn

    g = make_graph([("urn:a", "x", {})], [("urn:a", f"urn:{k}", "reads") for k in range(20)])
    g = g.with_edges(g.edges.withColumn("to_urn", counted.asNondeterministic()("to_urn")))
    graph_json.write_document(g, str(tmp_path / "doc"), "2024")
    assert rows.value == 20
