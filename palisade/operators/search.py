"""Search, details, neighbours, summaries and dashboard filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions import labels, meta
from palisade.model import Graph

# --- fixed values: fields a name search looks at ------------------------------
NAME_FIELDS = (
    "table_name column_name schema_name class_name function_name file_path database_name repo_name"
).split()
# --- fixed values: parents whose contains edges the dashboard calls structural
STRUCTURAL_PARENTS = ("database", "schema", "codebase", "file")


def _has(column: Column, needle: str) -> Column:
    return F.coalesce(F.lower(column).contains(needle.lower()), F.lit(False))


def matching_nodes(
    graph: Graph,
    node_type: str = "",
    name_pattern: str = "",
    urn_pattern: str = "",
    metadata_key: str = "",
    metadata_value: str = "",
) -> DataFrame:
    """Q1 filter: every given condition must hold; text tests are case-insensitive substrings.

    Without a type the dangling edge endpoints are searched too, as bare nodes.
    """
    nodes = graph.of_type(node_type) if node_type else graph.nodes
    hits = nodes
    if urn_pattern:
        hits = hits.filter(_has(F.col("urn"), urn_pattern))
    if name_pattern:
        # a missing field reads as the empty text, so only its value can match
        hits = hits.filter(reduce(Column.__or__, [_has(meta.get(nodes, k), name_pattern) for k in NAME_FIELDS]))
    if metadata_key:
        hits = hits.filter(meta.present(nodes, metadata_key))
        if metadata_value:
            hits = hits.filter(_has(meta.text(nodes, metadata_key), metadata_value))
    if node_type or name_pattern or metadata_key:
        return hits
    ends = graph.edges.select(F.explode(F.array("from_urn", "to_urn")).alias("urn"))
    if urn_pattern:
        ends = ends.filter(_has(F.col("urn"), urn_pattern))
    loose = ends.distinct().join(nodes.select("urn"), "urn", "left_anti")
    return hits.unionByName(loose.withColumn("node_type", F.lit("unknown")), allowMissingColumns=True)


def search_nodes(graph: Graph, limit: int = 50, offset: int = 0, **filters: str) -> DataFrame:
    """Q1/L3: one page in discovery order, each row carrying ``total`` and ``remaining``."""
    hits = matching_nodes(graph, **filters)
    total = hits.agg(F.count("*").alias("total")).scalar()
    page = (
        hits.select("urn", "node_type", labels.query_label(hits).alias("label"), "ord")
        .orderBy(F.col("ord").asc_nulls_last(), "urn")
        .offset(offset)
        .limit(limit)
    )
    return page.select(
        "urn", "node_type", "label", total.alias("total"),
        F.greatest(total - offset - limit, F.lit(0)).cast("bigint").alias("remaining"),
    )


def labelled(nodes: DataFrame) -> DataFrame:
    return nodes.select("urn", "node_type", labels.query_label(nodes).alias("label"))


def get_neighbors(graph: Graph, urn: str, direction: str = "both", edge_type: str = "") -> DataFrame:
    """Q3: out- then in-edges of a vertex with the other end's type and label.

    A self-loop shows up once per direction.  The other end may be dangling:
    then its type is ``unknown`` and its label the URN's tail.
    """
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError(f"direction must be outgoing, incoming or both, not {direction!r}")
    edges = graph.edges_of(edge_type) if edge_type else graph.edges
    leaves = (F.col("from_urn") == urn) & F.lit(direction != "incoming")
    enters = (F.col("to_urn") == urn) & F.lit(direction != "outgoing")
    views = F.filter(
        F.array(
            F.struct(leaves.alias("hit"), F.lit("out").alias("way"), F.col("to_urn").alias("urn")),
            F.struct(enters.alias("hit"), F.lit("in").alias("way"), F.col("from_urn").alias("urn")),
        ),
        lambda v: v["hit"],
    )
    # one pass over the edges serves both directions
    found = edges.filter(leaves | enters).select("edge_type", "ord", F.inline(views)).drop("hit")
    return _name_ends(found, graph).select("way", "edge_type", "urn", "node_type", "label")


def _name_ends(found: DataFrame, graph: Graph) -> DataFrame:
    return found.join(labelled(graph.nodes), "urn", "left").withColumns(
        {
            "node_type": F.coalesce("node_type", F.lit("unknown")),
            "label": F.coalesce("label", F.substring_index("urn", "/", -1)),
        }
    )


def get_node_details(graph: Graph, urn: str) -> DataFrame:
    """Q2: the node's metadata as key/value rows, then one row per edge."""
    node = graph.nodes.filter(F.col("urn") == urn)
    keys = meta.keys_of(node)
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), meta.text(node, k).alias("value")) for k in keys])
    facts = node.select(F.inline(F.filter(pairs, lambda p: p["value"].isNotNull())))
    links = get_neighbors(graph, urn)
    return facts.select(F.lit("metadata").alias("part"), "key", "value").unionByName(
        links.select(
            F.concat(F.col("way"), F.lit("_edge")).alias("part"),
            F.col("edge_type").alias("key"),
            F.concat(F.lit("["), "node_type", F.lit("] "), "label").alias("value"),
        )
    )


def metadata_filter(df: DataFrame, filters: dict[str, object], op: str = "OR") -> Column:
    """Q4: ``{key: True}`` asks for presence, ``{key: value}`` for equality; empty passes."""
    if not filters:
        return F.lit(True)
    tests = []
    for name, expected in filters.items():
        if expected is True:
            tests.append(meta.present(df, name))
        else:
            tests.append(F.coalesce(meta.get(df, name) == F.lit(expected), F.lit(False)))
    return reduce(Column.__and__ if op == "AND" else Column.__or__, tests)


def _marks(*names: str) -> list[Column]:
    """128 bits that stand for the values of string columns, where these are only told apart: a fifth of an edge's bytes."""
    parts = [x for name in names for x in (F.col(name).isNull(), F.col(name))]
    return [F.xxhash64(F.lit(seed), *parts).alias(f"mark_{seed}") for seed in (1, 2)]


def graph_summary(graph: Graph) -> DataFrame:
    """A1: long-form counts: per node type, per edge type (every occurrence), and totals.

    The edge total counts unique ``(from, to, uuid)``; the per-type counts do not.
    """
    nodes = graph.nodes.groupBy("node_type").agg(F.count("*").alias("n"))
    raw = graph.edges.groupBy("edge_type").agg(F.count("*").alias("n"))
    total_edges = graph.edges.select(*_marks("from_urn", "to_urn", "uuid")).distinct().agg(F.count("*").alias("n"))
    vertices = graph.vertices().agg(F.count("*").alias("n"))
    tables = graph.of_type("table")
    names = tables.select(meta.get(tables, "table_name").alias("t")).filter("t <> ''").distinct().agg(F.count("*").alias("n"))
    row = lambda df, kind, name: df.select(F.lit(kind).alias("kind"), name.alias("name"), "n")
    parts = [
        row(nodes, "node_type", F.col("node_type")),
        row(raw, "edge_type", F.col("edge_type")),
        row(vertices, "total", F.lit("nodes")),
        row(total_edges, "total", F.lit("edges")),
        row(names, "total", F.lit("table_names")),
    ]
    return reduce(DataFrame.unionByName, parts)


def table_names(graph: Graph) -> DataFrame:
    """A1: sorted distinct table names."""
    tables = graph.of_type("table")
    return tables.select(meta.get(tables, "table_name").alias("table_name")).filter("table_name <> ''").distinct().orderBy("table_name")


def type_counts(df: DataFrame, column: str) -> DataFrame:
    """Occurrences per type, sorted by type."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(column)


def dashboard_edges(graph: Graph, hidden_nodes: list[str], hidden_edges: list[str], hide_structural: bool = True) -> DataFrame:
    """Q10: edges left visible: type shown, both ends shown, structural ``contains`` dropped."""
    kinds = graph.nodes.select("urn", "node_type")
    shown = kinds.filter(~F.col("node_type").isin(hidden_nodes)) if hidden_nodes else kinds
    edges = graph.edges.filter(~F.col("edge_type").isin(hidden_edges)) if hidden_edges else graph.edges
    visible = edges.join(
        shown.select(F.col("urn").alias("from_urn"), F.col("node_type").alias("from_type")), "from_urn"
    ).join(shown.select(F.col("urn").alias("to_urn")), "to_urn", "left_semi")
    if hide_structural:
        structural = (F.col("edge_type") == "contains") & F.col("from_type").isin(*STRUCTURAL_PARENTS)
        visible = visible.filter(~structural)
    return visible.select("from_urn", "to_urn", "edge_type", "uuid")


def dashboard_search(graph: Graph, text: str = "", key: str = "", limit: int = 10) -> DataFrame:
    """Q11/L4: first hits whose URN contains the text and which carry the key."""
    nodes = graph.nodes
    hit = F.lit(True)
    if text:
        hit = hit & _has(F.col("urn"), text)
    if key:
        hit = hit & meta.present(nodes, key)
    return nodes.filter(hit).orderBy("ord", "urn").limit(limit).select("urn", "node_type")


def metadata_keys(graph: Graph) -> DataFrame:
    """Q12: sorted distinct metadata keys in use; one counting pass, no explode of the bag."""
    nodes = graph.nodes
    keys = meta.keys_of(nodes)
    counts = nodes.agg(*[F.count(F.col("metadata")[k]).alias(k) for k in keys])
    used = counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("n")) for k in keys])))
    if "extra" in nodes.columns:
        more = nodes.select(F.explode(F.map_keys("extra")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
        used = used.unionByName(more).groupBy("key").agg(F.sum("n").alias("n"))
    return used.filter("n > 0").orderBy("key")


def settle_edges(edges: DataFrame) -> DataFrame:
    """Store view of an edge list: per ``(from, to, uuid)`` the last occurrence wins."""
    rest = [c for c in edges.columns if c not in ("from_urn", "to_urn", "uuid")]
    if isinstance(edges.schema["ord"].dataType, T.NullType):
        return edges
    last = edges.groupBy("from_urn", "to_urn", "uuid").agg(
        F.max_by(F.struct(*rest), F.col("ord")).alias("_last")
    )
    return last.select("from_urn", "to_urn", "uuid", *[F.col("_last")[c].alias(c) for c in rest]).select(*edges.columns)
