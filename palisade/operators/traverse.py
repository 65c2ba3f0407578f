"""Graph traversal: reachability, ego graphs, shortest paths, components.

Every loop here moves one *level* per round over the stored links of the graph
(:mod:`palisade.operators.adjacency`).  A round is one join of the frontier with the links and
an anti-join against what was seen; it reads tables written by earlier rounds, so
lineage never grows and Spark sees their true sizes.  No round writes or shuffles
all links: a few vertices are looked up, a small frontier is broadcast, and only a
big one falls back to a shuffled join that AQE splits when one vertex holds much of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.model import Graph
from palisade.operators.adjacency import adjacency_of, measured, next_to
from palisade.session import stash, stash_at, stash_counted

UNBOUNDED = 1 << 30


def orient(edges: DataFrame, direction: str = "outgoing") -> DataFrame:
    """``(src, dst)`` pairs along, against or regardless of edge direction."""
    fwd = edges.select(F.col("from_urn").alias("src"), F.col("to_urn").alias("dst"))
    if direction == "outgoing":
        return fwd
    if direction == "incoming":
        return fwd.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if direction != "both":
        raise ValueError(f"direction must be outgoing, incoming or both, not {direction!r}")
    ends = F.array(
        F.struct(F.col("src"), F.col("dst")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
    )
    return fwd.select(F.inline(ends))


def adjacency(graph: Graph, types: list[str] | None, direction: str) -> DataFrame:
    """Stored ``(src, dst)`` pairs of the followed types; self-loops lead nowhere new.

    Repeated pairs are left in: every round deduplicates what it finds, which is
    cheaper than a shuffle of all edges up front.
    """
    return adjacency_of(graph).links(types, direction).select("src", "dst").filter("src <> dst")


def _seed(spark: SparkSession, start: str | DataFrame) -> DataFrame:
    if isinstance(start, str):
        return spark.range(1).select(F.lit(start).alias("urn"))
    return start.select("urn").distinct()


def reach(adj: DataFrame, start: str | DataFrame, max_depth: int = UNBOUNDED) -> DataFrame:
    """G1: ``(urn, depth)`` of all vertices within ``max_depth`` hops of the start set; ``adj`` is read once per hop."""
    spark = adj.sparkSession
    frontier, path = stash_at(_seed(spark, start).withColumn("depth", F.lit(0)), "level")
    size, few = measured(frontier)
    schema, levels = frontier.schema, [path]
    depth = 0
    while depth < max_depth:
        depth += 1
        seen = spark.read.schema(schema).parquet(*levels).select("urn")
        found = (
            next_to(adj, frontier.select(F.col("urn").alias("src")), few, size)
            .select(F.col("dst").alias("urn"))
            .distinct()
            .join(seen, "urn", "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        frontier, path = stash_at(found, "level")
        size, few = measured(frontier)
        if not size:
            break
        levels.append(path)
    return spark.read.schema(schema).parquet(*levels)


def trace_data_path(
    graph: Graph,
    start: str,
    edge_types: str = "references,soft_reference,reads,writes,models",
    max_depth: int = 10,
    direction: str = "outgoing",
) -> DataFrame:
    """Reachable vertices with their distance, the start itself left out (L1 order)."""
    adj = adjacency(graph, edge_types.split(","), direction)
    found = reach(adj, start, max_depth).filter(F.col("urn") != start)
    return with_node_type(found, graph).orderBy("depth", "urn")


def with_node_type(vertices: DataFrame, graph: Graph) -> DataFrame:
    """Attach node types; a dangling endpoint counts as ``unknown``."""
    kinds = graph.nodes.select("urn", "node_type")
    return vertices.join(kinds, "urn", "left").withColumn(
        "node_type", F.coalesce("node_type", F.lit("unknown"))
    )


def ego_nodes(graph: Graph, center: str, hops: int = 2) -> DataFrame:
    """G3/G8 vertex set: within ``hops`` of the center, ``contains`` not followed."""
    semantic = adjacency_of(graph).links(None, "both").filter("edge_type <> 'contains' and src <> dst")
    return reach(semantic.select("src", "dst"), center, hops)


def subgraph(graph: Graph, center: str, hops: int = 2) -> Graph:
    """Ego vertices and *all* edges among them, ``contains`` included."""
    inside = ego_nodes(graph, center, hops).select("urn")
    nodes = graph.nodes.join(inside, "urn", "left_semi")
    edges = induced(graph.edges, inside)
    return Graph(nodes, edges, graph.soft_links)


def subgraph_links(graph: Graph, center: str, hops: int = 2) -> DataFrame:
    """G3's edges without their metadata, from the stored links: ``(from_urn, to_urn, edge_type)``."""
    inside = ego_nodes(graph, center, hops).select("urn")
    links = adjacency_of(graph).links(None, "outgoing").select(F.col("src").alias("from_urn"), F.col("dst").alias("to_urn"), "edge_type")
    return induced(links, inside)


def induced(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """Edges with both ends in the vertex set."""
    return edges.join(inside.select(F.col("urn").alias("from_urn")), "from_urn", "left_semi").join(
        inside.select(F.col("urn").alias("to_urn")), "to_urn", "left_semi"
    )


def subgraph_type_counts(graph: Graph, center: str, hops: int = 2) -> DataFrame:
    """A10: how many ego vertices there are of each node type."""
    inside = ego_nodes(graph, center, hops)
    return with_node_type(inside, graph).groupBy("node_type").agg(F.count("*").alias("n"))


# --- shortest paths -----------------------------------------------------------


class _Balls:
    """Vertices around each of several ends, a layer at a time, with their least shortest path.

    A layer is ``(key, urn, path)``.  Links go both ways, so what a layer leads to lies in the
    layer before, the layer itself or the next one: only these two are looked at again.
    ``path`` leads away from the end, or towards it.  Paths are compared by their place in the order of
    their layer: numbers are hashed and shuffled where lists of URNs would be sorted and spilled.
    """

    def __init__(self, ends: DataFrame, away: bool):
        self.away, self.before = away, None
        self._keep(ends.select(F.col("urn").alias("key"), "urn", F.array("urn").alias("path")))

    def _keep(self, layer: DataFrame) -> None:
        self.layer, self._ranked = stash(layer, "ball"), None
        self.size, self.few = measured(self.layer)

    def ranked(self) -> DataFrame:
        """The layer with ``at``, the order of its paths, none of which comes twice."""
        if self._ranked is None:
            if self.few is not None:
                self._ranked = self.layer.coalesce(1).sortWithinPartitions("path").withColumn("at", F.monotonically_increasing_id())
            else:
                self._ranked = stash(self.layer.orderBy("path").withColumn("at", F.monotonically_increasing_id()), "ball")
        return self._ranked

    def grow(self, adj: DataFrame, open_ends: DataFrame | None) -> None:
        """One layer more, around all ends or those that are open."""
        ranked = self.ranked()
        frontier = ranked if open_ends is None else ranked.join(open_ends, "key", "left_semi")
        step = next_to(adj, frontier.select("key", F.col("urn").alias("src"), "at"), self.few, self.size)
        step = step.groupBy("key", F.col("dst").alias("urn")).agg(F.min("at").alias("at"))
        for old in [self.layer] if self.before is None else [self.layer, self.before]:
            step = step.join(old.select("key", "urn"), ["key", "urn"], "left_anti")
        own = F.array("urn")
        path = F.concat("path", own) if self.away else F.concat(own, F.col("path"))
        step = step.join(ranked.select("at", "path"), "at")
        self.before = self.layer
        self._keep(step.select("key", "urn", path.alias("path")))


def _met(near: _Balls, far: _Balls, before: DataFrame | None) -> DataFrame:
    """``(source, dest, path)`` of the pairs whose outermost layers meet now and not ``before``.

    A source's path to the meeting vertex tells the vertex, and with it the rest of the path.
    """
    ahead, back = near.ranked().select("at", F.col("key").alias("source"), "urn"), far.layer.select(F.col("key").alias("dest"), "urn")
    pairs = ahead.join(back, "urn").filter("source <> dest").groupBy("source", "dest").agg(F.min("at").alias("at"))
    if before is not None:
        pairs = pairs.join(before.select("source", "dest"), ["source", "dest"], "left_anti")
    pairs = pairs.join(near.ranked().select("at", "urn", F.col("path").alias("ahead")), "at")
    pairs = pairs.join(far.layer.select(F.col("key").alias("dest"), "urn", F.col("path").alias("back")), ["dest", "urn"])
    return pairs.select("source", "dest", F.concat("ahead", F.slice("back", 2, F.greatest(F.size("back") - 1, F.lit(0)))).alias("path"))


def _all_partners(sources: DataFrame, dests: DataFrame, n_sources: int, n_dests: int) -> tuple[DataFrame, DataFrame]:
    """As :func:`_partners`, as if all were in one component."""
    own = lambda ends, others, n: ends.join(others.withColumn("_o", F.lit(1)), "urn", "left").select("urn", (F.lit(n) - F.coalesce("_o", F.lit(0))).alias("wanted"))
    return own(sources, dests, n_dests), own(dests, sources, n_sources)


def _partners(adj: DataFrame, sources: DataFrame, dests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(urn, wanted)`` for the sources and for the destinations that have partners in their component, other than themselves."""
    parts = components(adj)
    ends = sources.withColumn("s", F.lit(1)).join(dests.withColumn("d", F.lit(1)), "urn", "full")
    ends = stash(ends.join(parts, "urn").select("urn", "component", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("d", F.lit(0)).alias("d")), "ends")
    per = ends.groupBy("component").agg(F.sum("s").alias("ss"), F.sum("d").alias("ds"))
    counted = stash(ends.join(per, "component"), "ends")
    both = F.col("s") * F.col("d")
    return (
        counted.filter("s = 1").select("urn", (F.col("ds") - both).alias("wanted")).filter("wanted > 0"),
        counted.filter("d = 1").select("urn", (F.col("ss") - both).alias("wanted")).filter("wanted > 0"),
    )


def shortest_paths(graph: Graph, sources: DataFrame, dests: DataFrame, edge_types: str = "") -> DataFrame:
    """Undirected shortest path of every source/destination pair that has one.

    ``sources`` and ``dests`` are frames of ``urn``.  Balls grow around both, the smaller side
    by a layer each round; where the outermost layers of a source and a destination first
    meet, their distance is the sum of the layers' numbers.  So balls reach half the distance,
    and an end stops growing when it has met all its partners.  With several ends, some of which have not met,
    components tell how many partners each has, as soon as balls have grown by as many vertices as there are links, all of
    which components take to find: from then on, no ball grows in vain.

    Ties go to the lexicographically least vertex sequence from the source: a ball keeps the
    least path of each vertex, and of the vertices where a pair meets the least path leads on.
    """
    types = edge_types.split(",") if edge_types else None
    adj = adjacency(graph, types, "both")
    sources = stash(sources.select("urn").distinct(), "ends")
    dests = stash(dests.select("urn").distinct(), "ends")
    (n_sources, source), (n_dests, dest) = measured(sources), measured(dests)
    wants, bound = None, None
    if n_sources * n_dests <= 1:
        total = int(n_sources * n_dests == 1 and source != dest)
    else:
        wants = _all_partners(sources, dests, n_sources, n_dests)
        total = int(wants[0].agg(F.sum("wanted")).first()[0] or 0)
    near, far = _Balls(sources, away=True), _Balls(dests, away=False)
    spark, schema, found, met = graph.spark, "source string, dest string, hops int, path array<string>", [], 0
    hops, grown, settled = 0, 0, False
    while met < total and near.size and far.size:
        if wants is not None and not settled and hops:
            bound = adjacency_of(graph).links(types, "outgoing").count() if bound is None else bound
            if grown > bound:
                # components are blind to direction, so one row of each link will do
                wants, settled = _partners(adjacency(graph, types, "outgoing"), sources, dests), True
                total = int(wants[0].agg(F.sum("wanted")).first()[0] or 0)
                continue
        hops += 1
        before = spark.read.schema(schema).parquet(*found) if found else None
        side, key = (near, "source") if near.size <= far.size else (far, "dest")
        open_ends = None
        if wants is not None and (settled or before is not None):
            open_ends = wants[key == "dest"].select(F.col("urn").alias("key"), "wanted")
            if before is not None:
                had = before.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
                open_ends = open_ends.join(had, "key", "left").filter("coalesce(n, 0) < wanted")
            open_ends = open_ends.select("key")
        side.grow(adj, open_ends)
        grown += side.size
        pairs = _met(near, far, before).select("source", "dest", F.lit(hops).alias("hops"), "path")
        _, place, n = stash_counted(pairs, "met")
        if n:
            found.append(place)
            met += n
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def find_shortest_path(graph: Graph, source: str, dest: str, edge_types: str = "") -> DataFrame:
    """One row per vertex of the path, with the edge type leading to the next one.

    The label prefers an edge pointing along the path; where several types do,
    the least id wins, as every label lookup must name one edge.
    """
    spark = graph.spark
    if source == dest:
        return spark.range(1).select(F.lit(0).alias("step"), F.lit(source).alias("urn"), F.lit(None).cast("string").alias("arrow"))
    ends = [spark.range(1).select(F.lit(urn).alias("urn")) for urn in (source, dest)]
    hops = stash(shortest_paths(graph, *ends, edge_types).select(F.posexplode("path").alias("step", "urn")), "hops")
    size, few = measured(hops)
    links = hops.join(hops.select((F.col("step") - 1).alias("step"), F.col("urn").alias("next")), "step").withColumnRenamed("urn", "src")
    leading = next_to(adjacency_of(graph).links(None, "both"), links, few, size).filter(F.col("dst") == F.col("next"))
    leading = leading.select("step", "src", "next", (F.col("way") == "in").alias("rank"), "edge_type").distinct()
    best = leading.groupBy("step").agg(F.min("rank").alias("rank"), F.count("*").alias("n"))
    kinds = stash(leading.join(best, ["step", "rank"]), "arrows")
    ids = _least_ids(graph, kinds.filter("n > 1"))
    arrow = F.concat(F.when(F.col("rank"), "<--").otherwise("-->"), F.col("edge_type"))
    arrows = (
        kinds.select("step", "edge_type", arrow.alias("arrow"))
        .join(ids, F.expr("step = _step and edge_type <=> _type"), "left")
        .groupBy("step")
        .agg(F.min(F.struct("id", "arrow"))["arrow"].alias("arrow"))
    )
    return hops.join(arrows, "step", "left").select("step", "urn", "arrow").orderBy("step")


def _least_ids(graph: Graph, kinds: DataFrame) -> DataFrame:
    """``(_step, _type, id)``: the least id of the edges of each ``(step, src, next, rank, edge_type)``, read of their types only."""
    types = [r[0] for r in kinds.select("edge_type").distinct().collect()]
    ends = kinds.select(
        F.col("step").alias("_step"), F.col("edge_type").alias("_type"),
        F.when(F.col("rank"), F.col("next")).otherwise(F.col("src")).alias("from_urn"),
        F.when(F.col("rank"), F.col("src")).otherwise(F.col("next")).alias("to_urn"),
    )
    edges = graph.edges if None in types or not types else graph.edges_of(*types)
    if not types or "uuid" not in edges.columns:
        return ends.select("_step", "_type", F.struct(F.lit(None).cast("string").alias("uuid")).alias("id")).limit(0)
    own = edges.select("uuid", "from_urn", "to_urn", "edge_type").join(ends, ["from_urn", "to_urn"]).filter("edge_type <=> _type")
    return own.groupBy("_step", "_type").agg(F.min(F.struct("uuid")).alias("id"))


# --- connected components -----------------------------------------------------


def components(pairs: DataFrame) -> DataFrame:
    """``(urn, component)`` for every vertex of ``(src, dst)``; label = least URN.

    Alternating large-star / small-star rounds: each re-attaches a vertex's
    neighbours to the least vertex it knows, so the number of rounds grows with
    the logarithm of the longest chain.  Star centres are aggregated (with
    map-side combine) and joined back, never collected, so a component holding
    most of the graph stays spread over all tasks.
    """
    edges = stash(_downhill(pairs), "cc")
    signature = None
    while True:
        large = stash(_large_star(edges), "cc")
        edges = stash(_small_star(large), "cc")
        now = tuple(
            edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        )
        if now == signature:
            break
        signature = now
    stars = edges.select(F.col("hi").alias("urn"), F.col("lo").alias("component"))
    roots = edges.select(F.col("lo").alias("urn"), F.col("lo").alias("component")).distinct()
    loops = (
        pairs.filter("src = dst")
        .select(F.col("src").alias("urn"), F.col("src").alias("component"))
        .distinct()
        .join(stars.unionAll(roots).select("urn"), "urn", "left_anti")
    )
    return stars.unionAll(roots).unionAll(loops)


def _downhill(pairs: DataFrame) -> DataFrame:
    """Pairs as ``hi > lo``, distinct, loops dropped."""
    return (
        pairs.filter("src <> dst")
        .select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo"))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")),
                F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")),
            )
        )
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    own = least.select("hi", F.col("m").alias("lo"))
    return moved.unionAll(own).distinct()


def weak_components(graph: Graph, types: tuple[str, ...] = ("calls", "instantiates")) -> DataFrame:
    """G5 over the graph's call edges."""
    return components(orient(graph.edges_of(*types)))


__all__ = [
    "adjacency", "components", "ego_nodes", "find_shortest_path", "induced", "orient", "reach",
    "shortest_paths", "subgraph", "subgraph_links", "subgraph_type_counts", "trace_data_path",
    "weak_components", "with_node_type",
]
