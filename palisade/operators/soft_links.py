"""User-made links between nodes (M3-M5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions import ids, meta
from palisade.functions.scalars import CONFIDENCE_LEVELS, confidence_score
from palisade.model import DEFAULT_ORG, SOFT_LINK_SCHEMA, Graph, union_all
from palisade.operators.adjacency import adjacency_of
from palisade.operators.search import labelled
from palisade.session import stash

# --- fixed values: edge types a user may create -------------------------------
LINK_TYPES = "builds reads writes references models calls depends_on contains soft_reference".split()
DEFAULT_TYPE = "soft_reference"
DEFAULT_CONFIDENCE = 0.7


def check_links(graph: Graph, requests: DataFrame) -> DataFrame:
    """M3 validation in bulk: requests with an ``error`` text, NULL when acceptable.

    ``requests`` has ``from_urn, to_urn, edge_type, confidence_level, note, created_at``.
    Checks in order: endpoints exist, type and confidence known, not a duplicate.
    """
    known = known_urns(graph, requests)
    old = (graph.soft_links if graph.soft_links is not None else graph.spark.createDataFrame([], SOFT_LINK_SCHEMA)).select(
        "from_urn", "to_urn", "edge_type", F.col("id").alias("_dup")
    )
    req = requests.withColumns(
        {
            "edge_type": F.coalesce("edge_type", F.lit(DEFAULT_TYPE)),
            "confidence_level": F.upper(F.coalesce("confidence_level", F.lit("MEDIUM"))),
        }
    )
    req = (
        req.join(known.select(F.col("urn").alias("from_urn"), F.lit(True).alias("_from")), "from_urn", "left")
        .join(known.select(F.col("urn").alias("to_urn"), F.lit(True).alias("_to")), "to_urn", "left")
        .join(old.groupBy("from_urn", "to_urn", "edge_type").agg(F.min("_dup").alias("_dup")), ["from_urn", "to_urn", "edge_type"], "left")
    )
    error = (
        F.when(F.col("_from").isNull(), F.concat(F.lit("from_urn not found in graph: "), "from_urn"))
        .when(F.col("_to").isNull(), F.concat(F.lit("to_urn not found in graph: "), "to_urn"))
        .when(~F.col("edge_type").isin(*LINK_TYPES), F.concat(F.lit("invalid edge_type: "), "edge_type"))
        .when(~F.col("confidence_level").isin(*CONFIDENCE_LEVELS), F.concat(F.lit("invalid confidence: "), "confidence_level"))
        .when(F.col("_dup").isNotNull(), F.concat(F.lit("soft link already exists: "), "_dup"))
    )
    return req.withColumn("error", error).drop("_from", "_to", "_dup")


def known_urns(graph: Graph, links: DataFrame) -> DataFrame:
    """Endpoints of ``links`` that are vertices of the graph.

    Only the asked-for URNs are looked up, among the nodes first: the ends of the edges, of which there are
    far more, are read for those that are no nodes, and where these are few no end is shuffled.
    """
    asked = links.select(F.explode(F.array("from_urn", "to_urn")).alias("urn")).distinct()
    asked = stash(asked.filter("urn is not null"), "asked")
    nodes = stash(graph.nodes.select("urn").join(asked, "urn", "left_semi").distinct(), "known")
    bare = stash(asked.join(nodes, "urn", "left_anti"), "bare")
    if bare.isEmpty():
        return nodes
    ends = graph.edges.select(F.explode(F.array("from_urn", "to_urn")).alias("urn"))
    return stash(nodes.unionAll(ends.join(bare, "urn", "left_semi").distinct()), "known")


def accept_links(checked: DataFrame) -> DataFrame:
    """M3: acceptable requests as soft links; equal requests in one batch collapse.

    The id is derived from the link itself, so a retried task writes the same id.
    """
    good = checked.filter("error is null")
    once = good.groupBy("from_urn", "to_urn", "edge_type").agg(
        F.min(F.struct("created_at", "confidence_level", "note")).alias("r")
    )
    return once.select(
        ids.soft_link_edge_id(F.col("from_urn"), F.col("to_urn"), F.concat(F.lit("link:"), "edge_type")).alias("id"),
        "from_urn", "to_urn", "edge_type", F.lit("soft_link").alias("detection_method"),
        confidence_score(F.col("r.confidence_level")).alias("confidence"),
        F.col("r.confidence_level").alias("confidence_level"), F.col("r.note").alias("note"),
        F.col("r.created_at").alias("created_at"),
    )


def add_soft_links(graph: Graph, requests: DataFrame) -> Graph:
    """M3: the graph with all acceptable requests added; the accepted links are written once."""
    links = stash(accept_links(check_links(graph, requests)), "links")
    old = graph.soft_links
    return Graph(graph.nodes, graph.edges, links if old is None else old.unionByName(links))


def list_soft_links(graph: Graph) -> DataFrame:
    """M4: links with the labels and types of both ends."""
    names = labelled(graph.nodes)
    side = lambda end: names.select(
        F.col("urn").alias(f"{end}_urn"), F.col("label").alias(f"{end}_label"), F.col("node_type").alias(f"{end}_type")
    )
    links = graph.soft_links.join(side("from"), "from_urn", "left").join(side("to"), "to_urn", "left")
    return links.select(
        "id", F.coalesce("from_type", F.lit("unknown")).alias("from_type"),
        F.coalesce("from_label", F.substring_index("from_urn", "/", -1)).alias("from_label"),
        F.coalesce("to_type", F.lit("unknown")).alias("to_type"),
        F.coalesce("to_label", F.substring_index("to_urn", "/", -1)).alias("to_label"),
        "edge_type", "confidence", "confidence_level", "note", "created_at",
    )


def remove_soft_links(graph: Graph, ids_frame: DataFrame) -> Graph:
    """M5: drop links by id.  Their edges are derived, so they go with them."""
    return Graph(graph.nodes, graph.edges, graph.soft_links.join(ids_frame.select("id"), "id", "left_anti"))


def link_edges(graph: Graph, compat: bool = False) -> DataFrame:
    """Edges the soft links stand for; links with an unknown endpoint are skipped."""
    known = known_urns(graph, graph.soft_links)
    valid = graph.soft_links.join(known.select(F.col("urn").alias("from_urn")), "from_urn", "left_semi").join(
        known.select(F.col("urn").alias("to_urn")), "to_urn", "left_semi"
    )
    kind = F.coalesce("edge_type", F.lit("reads"))
    return valid.select(
        ids.soft_link_edge_id(F.col("from_urn"), F.col("to_urn"), kind, compat).alias("uuid"),
        F.lit(DEFAULT_ORG).alias("organization_id"), "from_urn", "to_urn", kind.alias("edge_type"),
        meta.pack(
            detection_method=F.coalesce("detection_method", F.lit("soft_link")),
            confidence=F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE)), note=F.coalesce("note", F.lit("")),
        ).alias("metadata"),
        # after every scanned edge, in creation order
        (F.lit(1 << 60) + F.coalesce(F.unix_micros(F.try_to_timestamp("created_at")), F.lit(0)).cast("bigint")).alias("ord"),
    )


def with_link_edges(graph: Graph, compat: bool = False) -> Graph:
    """The graph as questions see it: scanned edges plus the soft links' edges."""
    if graph.soft_links is None:
        return graph
    edges = link_edges(graph, compat)
    linked = Graph(graph.nodes, union_all([graph.edges, edges]), graph.soft_links)
    # what is stored of the scanned edges serves the whole; links are made by hand, so few
    object.__setattr__(linked, "_adjacency", adjacency_of(graph).plus(edges))
    return linked
