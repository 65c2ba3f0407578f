import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from palisade.model import Graph
from palisade.operators import code_data, search, security, soft_links, traverse
from palisade.operators.adjacency import SOME, adjacency_of, next_to
from palisade.sources.store import ParquetStore

RNG = random.Random(11)
N = 40
LINKS = sorted({(f"urn:v{RNG.randint(0, N)}", f"urn:v{RNG.randint(0, N)}", RNG.choice(["calls", "reads", "contains"])) for _ in range(70)})


@pytest.fixture(scope="module")
def graph(spark):
    rows = [(f"id{i:03d}", a, b, t, i) for i, (a, b, t) in enumerate(LINKS)]
    edges = spark.createDataFrame(rows, "uuid string, from_urn string, to_urn string, edge_type string, ord bigint")
    edges = edges.withColumn("metadata", F.struct(F.lit(None).cast("string").alias("detection_method")))
    nodes = spark.createDataFrame([(f"urn:v{i}", "function" if i % 2 else "table", i) for i in range(N - 5)], "urn string, node_type string, ord bigint")
    nodes = nodes.select("urn", "node_type", "ord", F.lit(None).cast("string").alias("parent_urn"), F.struct(F.col("urn").alias("function_name")).alias("metadata"))
    return Graph(nodes, edges)


def brute_reach(starts, links, depth):
    seen, queue = {s: 0 for s in starts}, deque(starts)
    while queue:
        at = queue.popleft()
        for a, b in links:
            if a == at and b not in seen and seen[at] < depth:
                seen[b] = seen[at] + 1
                queue.append(b)
    return seen


def oriented(direction, types):
    out = [(a, b) for a, b, t in LINKS if t in types]
    back = [(b, a) for a, b in out]
    return {"outgoing": out, "incoming": back, "both": out + back}[direction]


@pytest.mark.parametrize("direction", ["outgoing", "incoming", "both"])
def test_reach_equals_brute_force(graph, direction):
    adj = traverse.adjacency(graph, ["calls", "reads"], direction)
    got = {r.urn: r.depth for r in traverse.reach(adj, "urn:v1", 4).collect()}
    assert got == brute_reach(["urn:v1"], oriented(direction, ("calls", "reads")), 4)


def test_reverse_reach_is_reach_of_reversed_graph(graph):
    flipped = graph.with_edges(graph.edges.selectExpr("to_urn as from_urn", "from_urn as to_urn", "edge_type"))
    a = traverse.reach(traverse.adjacency(graph, None, "incoming"), "urn:v2", 3)
    b = traverse.reach(traverse.adjacency(flipped, None, "outgoing"), "urn:v2", 3)
    assert sorted(a.collect()) == sorted(b.collect())


def test_components_equal_brute_force_and_ignore_direction(graph, spark):
    links = oriented("both", ("calls", "reads"))
    want = {}
    for v in {v for pair in links for v in pair}:
        want[v] = min(brute_reach([v], links, 999))
    for direction in ("outgoing", "incoming"):
        got = traverse.components(traverse.orient(graph.edges_of("calls", "reads"), direction)).collect()
        assert {r.urn: r.component for r in got} == want and len(got) == len(want)
    chain = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("z", "z")], "src string, dst string")
    assert {(r.component, r.urn == "z") for r in traverse.components(chain).collect()} == {("000", False), ("z", True)}


def test_shortest_paths_are_least(graph, spark):
    links = oriented("both", ("calls", "reads", "contains"))
    ends = [f"urn:v{i}" for i in (1, 5, 9, 17)]
    frame = spark.createDataFrame([(e,) for e in ends], "urn string")
    got = {(r.source, r.dest): r.path for r in traverse.shortest_paths(graph, frame, frame).collect()}
    want = {}
    for dest in ends:
        dist = brute_reach([dest], links, 999)
        for source in ends:
            if source != dest and source in dist:
                path = [source]
                while path[-1] != dest:
                    path.append(min(b for a, b in links if a == path[-1] and dist.get(b) == dist[path[-1]] - 1))
                want[(source, dest)] = path
    assert got == want


def test_shortest_path_arrows(make_graph):
    g = make_graph([("urn:a", "x", {}), ("urn:b", "x", {}), ("urn:c", "x", {})], [("urn:a", "urn:b", "reads"), ("urn:c", "urn:b", "calls"), ("urn:b", "urn:a", "hosts")])
    rows = traverse.find_shortest_path(g, "urn:a", "urn:c").collect()
    assert [(r.step, r.urn, r.arrow) for r in rows] == [(0, "urn:a", "-->reads"), (1, "urn:b", "<--calls"), (2, "urn:c", None)]
    assert traverse.find_shortest_path(g, "urn:a", "urn:zz").count() == 0
    assert [r.urn for r in traverse.find_shortest_path(g, "urn:a", "urn:a").collect()] == ["urn:a"]


def test_subgraph_skips_contains_but_keeps_it_inside(make_graph):
    g = make_graph(
        [(u, "x", {}) for u in ("urn:a", "urn:b", "urn:p", "urn:far")],
        [("urn:a", "urn:b", "reads"), ("urn:a", "urn:b", "contains"), ("urn:p", "urn:a", "contains"), ("urn:p", "urn:far", "reads")],
    )
    sub = traverse.subgraph(g, "urn:a", 2)
    assert sorted(r.urn for r in sub.nodes.collect()) == ["urn:a", "urn:b"]
    assert sorted(r.edge_type for r in sub.edges.collect()) == ["contains", "reads"]


def test_search_and_neighbours(make_graph):
    g = make_graph(
        [("urn:a/x", "table", {"table_name": "Blue", "odd_key": [1]}), ("urn:b/y", "function", {"function_name": "f", "is_method": True})],
        [("urn:b/y", "urn:a/x", "reads"), ("urn:b/y", "urn:b/y", "calls"), ("urn:b/y", "urn:lost/end", "writes")],
    )
    page = search.search_nodes(g, name_pattern="LU", limit=1).collect()
    assert [(r.urn, r.total, r.remaining) for r in page] == [("urn:a/x", 1, 0)]
    assert [r.urn for r in search.matching_nodes(g, metadata_key="odd_key").collect()] == ["urn:a/x"]
    assert [r.urn for r in search.matching_nodes(g, metadata_key="is_method", metadata_value="true").collect()] == ["urn:b/y"]
    assert [r.urn for r in search.matching_nodes(g, urn_pattern="lost").collect()] == ["urn:lost/end"]
    near = search.get_neighbors(g, "urn:b/y").collect()
    assert sorted((r.way, r.edge_type, r.node_type, r.label) for r in near) == [
        ("in", "calls", "function", "f"), ("out", "calls", "function", "f"), ("out", "reads", "table", "Blue"), ("out", "writes", "unknown", "end"),
    ]
    assert {r.key for r in search.metadata_keys(g).collect()} == {"table_name", "odd_key", "function_name", "is_method"}


def test_orphans_count_self_links_twice(make_graph):
    g = make_graph([("urn:t", "table", {"table_name": "t"}), ("urn:u", "table", {"table_name": "u"})], [("urn:t", "urn:t", "references"), ("urn:f", "urn:u", "reads")])
    assert [(r.table_name, r.schema_name, r.fk_edges) for r in code_data.find_orphaned_tables(g).collect()] == [("t", "?", 2)]


def test_last_table_of_a_name_answers(make_graph):
    g = make_graph(
        [("urn:t1", "table", {"table_name": "t"}), ("urn:t2", "table", {"table_name": "t"}), ("urn:c", "class", {"class_name": "C", "file_path": "c.py"})],
        [("urn:c", "urn:t1", "models", {"detection_method": "orm_tablename"}), ("urn:c", "urn:t2", "models", {"detection_method": "orm_tablename"})],
    )
    assert code_data.find_code_for_table(g, "t").count() == 1
    assert [(r.table_name, r.models, r.functions) for r in code_data.table_access_counts(g).collect()] == [("t", 2, 0)]


def test_attack_surface(make_graph):
    g = make_graph(
        [
            ("urn:d", "dns_record", {"dns_record_name": "www", "dns_zone_private": False}), ("urn:p", "dns_record", {"dns_record_name": "int", "dns_zone_private": True}),
            ("urn:lb", "load_balancer", {"lb_scheme": "internet-facing", "lb_type": "alb", "lb_dns_name": "lb"}), ("urn:lb2", "load_balancer", {"lb_scheme": "internet-facing"}),
            ("urn:bg", "backend_group", {}), ("urn:s", "ecs_service", {"ecs_service_name": "svc", "ecs_public_ip": True}), ("urn:td", "ecs_task_definition", {}),
            ("urn:r", "iam_role", {"role_name": "role"}), ("urn:sg", "security_group", {"sg_name": "web", "sg_rules_ingress": [{"cidr": "0.0.0.0/0"}]}),
        ],
        [
            ("urn:d", "urn:lb", "resolves_to"), ("urn:d", "urn:lb2", "resolves_to"), ("urn:p", "urn:lb", "resolves_to"), ("urn:lb", "urn:bg", "routes_to"), ("urn:bg", "urn:s", "routes_to"),
            ("urn:s", "urn:td", "references"), ("urn:td", "urn:r", "assumes"), ("urn:lb", "urn:sg", "protected_by"),
        ],
    )
    got = security.find_public_attack_surface(g).collect()
    assert sorted((r.kind, r.lb_urn or "", r.service or "", r.security_groups or "", r.iam_roles or "") for r in got) == [
        ("chain", "urn:lb", "svc", "web [PUBLIC]", "role"), ("chain", "urn:lb2", "", "", ""), ("direct", "", "svc", "", "role"),
    ]
    assert security.find_public_attack_surface(g, include_internal=True).count() == 4


def test_permissions_modes(make_graph):
    g = make_graph([("urn:r", "identity", {"role_name": "app", "role_superuser": True}), ("urn:t", "table", {"table_name": "t"})], [("urn:r", "urn:t", "reads", {"privilege": "SELECT"})])
    assert [(r.role_name, r.privilege, r.superuser) for r in security.find_database_permissions(g).collect()] == [("app", "SELECT", True)]
    assert security.find_database_permissions(g, compat=True).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_from_both_ends_equal_brute_force(spark, seed):
    """Several components, hubs, ends that are both source and destination, ends nobody reaches."""
    chance = random.Random(seed)
    n = 26
    pairs = {(f"v{chance.randrange(n):02}", f"v{chance.randrange(n):02}") for _ in range(chance.choice([14, 22, 40]))}
    pairs |= {("v00", f"v{i:02}") for i in range(1, 26, 5)} if seed % 2 else set()
    edges = spark.createDataFrame([(f"e{i}", a, b, chance.choice(["calls", "reads"])) for i, (a, b) in enumerate(sorted(pairs))], "uuid string, from_urn string, to_urn string, edge_type string")
    g = Graph(edges.select(F.col("from_urn").alias("urn"), F.lit("x").alias("node_type")), edges)
    links = [*pairs, *((b, a) for a, b in pairs)]
    sources, dests = (sorted({f"v{chance.randrange(n):02}" for _ in range(5)} | {"gone"}) for _ in range(2))
    want = {}
    for d in dests:
        dist = brute_reach([d], links, 999)
        for s in sources:
            if s != d and s in dist:
                path = [s]
                while path[-1] != d:
                    path.append(min(b for a, b in links if a == path[-1] and dist.get(b) == dist[path[-1]] - 1))
                want[s, d] = path
    frame = lambda ends: spark.createDataFrame([(e,) for e in ends], "urn string")
    got = traverse.shortest_paths(g, frame(sources), frame(dests)).collect()
    assert {(r.source, r.dest): r.path for r in got} == want and len(got) == len(want)
    assert all(r.hops == len(r.path) - 1 for r in got)
    lone = [(sources[0], dests[-1])]
    for s, d in lone:
        assert [r.path for r in traverse.shortest_paths(g, frame([s]), frame([d])).collect()] == ([want[s, d]] if (s, d) in want else [])


def test_links_are_written_once_and_read_by_type(make_graph, spark):
    g = make_graph([(f"urn:{c}", "x", {}) for c in "abc"], [("urn:a", "urn:b", "reads"), ("urn:b", "urn:c", "calls"), ("urn:a", "urn:a", "reads")])
    first = traverse.adjacency(g, ["reads"], "outgoing")
    assert [tuple(r) for r in first.collect()] == [("urn:a", "urn:b")]
    own = adjacency_of(g)
    assert len(own.parts) == 1 and own.parts[0][0] == {"reads"}
    traverse.reach(first, "urn:a").count()
    assert len(adjacency_of(g).parts) == 1
    assert sorted((r.src, r.dst, r.way) for r in own.links(["reads", "calls"], "both").collect()) == sorted(
        [("urn:a", "urn:b", "out"), ("urn:b", "urn:a", "in"), ("urn:b", "urn:c", "out"), ("urn:c", "urn:b", "in"), ("urn:a", "urn:a", "out"), ("urn:a", "urn:a", "in")]
    )
    assert sorted((ways, sorted(held)) for held, ways, _ in own.parts) == [(("in",), ["calls", "reads"]), (("out",), ["calls"]), (("out",), ["reads"])]
    plan = own.links(["calls"], "incoming")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "DataFilters: []" in plan
    with pytest.raises(ValueError):
        own.links(None, "sideways")


def test_search_over_store_and_soft_links(make_graph, spark, tmp_path):
    g = make_graph([(f"urn:{c}", "function", {"function_name": c}) for c in "abcd"], [("urn:a", "urn:b", "calls"), ("urn:b", "urn:c", "reads")])
    store = ParquetStore(spark, str(tmp_path / "store"))
    store.write(g)
    ask = "from_urn string, to_urn string, edge_type string, confidence_level string, note string, created_at string"
    store.add_soft_links(spark.createDataFrame([("urn:c", "urn:d", "calls", "HIGH", "", "2024-01-01")], ask))
    kept = soft_links.with_link_edges(store.read())
    assert {r.urn: r.depth for r in traverse.reach(traverse.adjacency(kept, None, "outgoing"), "urn:a").collect()} == {"urn:a": 0, "urn:b": 1, "urn:c": 2, "urn:d": 3}
    assert adjacency_of(kept).parts[0][2].startswith(str(tmp_path))
    assert [r.urn for r in traverse.find_shortest_path(kept, "urn:d", "urn:a").collect()] == ["urn:d", "urn:c", "urn:b", "urn:a"]
    assert sorted(r.edge_type for r in traverse.subgraph_links(kept, "urn:c", 1).collect()) == ["calls", "reads"]


def test_links_carry_no_ids_and_a_store_keeps_those_along_edges_once(make_graph, spark, tmp_path):
    g = make_graph([(f"urn:{c}", "x", {}) for c in "abc"], [("urn:a", "urn:b", "reads"), ("urn:c", "urn:b", "calls"), ("urn:a", "urn:b", "calls")])
    store = ParquetStore(spark, str(tmp_path / "store"))
    version = store.write(g)
    assert [p.name for p in (tmp_path / "store" / version / "links").glob("way=*")] == ["way=in"]
    for graph in (g, store.read()):
        links = adjacency_of(graph).links(None, "both")
        assert links.columns == ["src", "dst", "way", "edge_type"]
        out = [("urn:a", "urn:b", "out", "calls"), ("urn:a", "urn:b", "out", "reads"), ("urn:c", "urn:b", "out", "calls")]
        assert sorted(map(tuple, links.collect())) == sorted(out + [(b, a, "in", t) for a, b, _, t in out])
        # of several edges the least id names the arrow: e0 reads, e2 calls
        assert [r.arrow for r in traverse.find_shortest_path(graph, "urn:a", "urn:c").collect()] == ["-->reads", "<--calls", None]


def test_links_of_a_frontier_are_picked_out_before_they_are_shuffled(spark):
    links = spark.range(2000).selectExpr("concat('urn:', id % 500) as src", "concat('urn:x', id) as dst")
    frontier = spark.range(100).selectExpr("concat('urn:', id) as src", "id as key").unionAll(spark.createDataFrame([("urn:3", 7), (None, 8)], "src string, key bigint"))
    got = next_to(links, frontier, None, 102)
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, links.join(frontier, "src").collect()))


def test_edge_total_moves_no_urns(spark, make_graph):
    """Equal edges count once, missing ends are told apart, and 128 bits an edge are shuffled."""
    g = make_graph([("a", "table", {"table_name": "t"})], [("a", "b", "reads"), ("b", "a", "reads")])
    once = g.edges.withColumn("uuid", F.lit("u"))
    loose = [once.withColumn(c, F.lit(None).cast("string")) for c in ("from_urn", "to_urn")]
    g = g.with_edges(once.unionByName(once).unionByName(loose[0].withColumn("to_urn", F.lit("x"))).unionByName(loose[1].withColumn("from_urn", F.lit("x"))))
    summary = search.graph_summary(g)
    rows = {(r.kind, r.name): r.n for r in summary.collect()}
    assert rows["total", "edges"] == 4 and rows["edge_type", "reads"] == 8
    assert "Aggregate [from_urn" not in summary._jdf.queryExecution().optimizedPlan().toString()


def test_accesses_are_counted_before_tables_are_looked_up(make_graph):
    """Of tables and code with one name or URN, each counts; code or tables that are not there do not."""
    nodes = [("t1", "table", {"table_name": "t"}), ("t2", "table", {"table_name": "t"}), ("t3", "table", {}), ("c", "class", {}), ("f", "function", {}), ("f", "function", {})]
    edges = [("c", "t1", "models", {"detection_method": "orm_tablename"}), ("f", "t1", "reads"), ("f", "t2", "writes"), ("f", "t3", "reads"), ("gone", "t1", "reads"), ("f", "gone", "reads")]
    counts = code_data.table_access_counts(make_graph(nodes, edges))
    assert sorted(map(tuple, counts.collect())) == [("?", 0, 2), ("t", 1, 4)]
    assert "Aggregate [to_urn" in counts._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in code_data.table_access_counts(make_graph(nodes, edges), "t").collect()] == [("t", 1, 4)]


def _star(spark, *more):
    """Five hubs in a ring with ten leaves each, and further links."""
    pairs = [(f"h{i}", f"h{(i + 1) % 5}") for i in range(5)] + [(f"l{i:02}", f"h{i % 5}") for i in range(50)] + list(more)
    edges = spark.createDataFrame([(f"e{k}", a, b, "calls") for k, (a, b) in enumerate(pairs)], "uuid string, from_urn string, to_urn string, edge_type string")
    return Graph(edges.select(F.col("from_urn").alias("urn"), F.lit("x").alias("node_type")), edges)


def test_components_are_asked_for_only_where_balls_grow_in_vain(spark, monkeypatch):
    asked, own = [], traverse._partners
    monkeypatch.setattr(traverse, "_partners", lambda *ends: asked.append(1) or own(*ends))
    frame = lambda *ends: spark.createDataFrame([(e,) for e in ends], "urn string")
    met = traverse.shortest_paths(_star(spark), frame("h0", "l01", "h2"), frame("h2", "l03")).collect()
    assert not asked
    assert {(r.source, r.dest): r.path for r in met} == {
        ("h0", "h2"): ["h0", "h1", "h2"], ("l01", "h2"): ["l01", "h1", "h2"], ("h0", "l03"): ["h0", "h4", "h3", "l03"],
        ("l01", "l03"): ["l01", "h1", "h2", "h3", "l03"], ("h2", "l03"): ["h2", "h3", "l03"],
    }
    # a long chain that no other end is on
    far = traverse.shortest_paths(_star(spark, *[(f"c{i:03}", f"c{i + 1:03}") for i in range(3)]), frame(*(f"l{i:02}" for i in range(20)), "c000"), frame(*(f"l{i:02}" for i in range(20, 40)), "c001", "gone")).collect()
    assert asked and len(far) == 20 * 20 + 1


def test_layers_compare_numbers_not_paths(spark, monkeypatch):
    plans, own = [], traverse.stash
    monkeypatch.setattr(traverse, "stash", lambda df, label: plans.append((label, df._jdf.queryExecution().executedPlan().toString())) or own(df, label))
    frame = lambda *ends: spark.createDataFrame([(e,) for e in ends], "urn string")
    traverse.shortest_paths(_star(spark), frame("l00", "l01"), frame("l03"))
    grown = [p for label, p in plans if label == "ball" and "Aggregate" in p]
    assert grown and all("SortAggregate" not in p and "HashAggregate" in p for p in grown)


def test_links_of_a_big_frontier_are_not_sorted(spark):
    links = spark.range(2000).selectExpr("concat('urn:', id % 500) as src", "concat('urn:x', id) as dst")
    frontier = spark.range(100).selectExpr("concat('urn:', id) as src", "id as key").unionAll(spark.createDataFrame([("urn:3", 7), (None, 8)], "src string, key bigint"))
    got = next_to(links, frontier, None, SOME + 1)
    assert "ShuffledHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, links.join(frontier, "src").collect()))
