"""Report of edges their end nodes do not admit (never fatal)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.model import Graph, legal_edges


def _rule_frame(graph: Graph) -> DataFrame:
    rows = [
        (side, kind, sorted(ways[i])) for kind, ways in legal_edges().items() for i, side in enumerate(("outgoing", "incoming"))
    ]
    return graph.spark.createDataFrame(rows, "side string, node_type string, allowed array<string>")


def violations(graph: Graph) -> DataFrame:
    """0-2 rows per edge; ends without a rule set (bare or dangling nodes) are skipped."""
    kinds = graph.nodes.select("urn", "node_type")
    # an end and the other one: three texts of URNs would be shuffled instead of two
    sides = F.array(
        F.struct(F.lit("outgoing").alias("side"), F.col("from_urn").alias("urn"), F.col("to_urn").alias("other")),
        F.struct(F.lit("incoming").alias("side"), F.col("to_urn").alias("urn"), F.col("from_urn").alias("other")),
    )
    ends = graph.edges.select("uuid", "edge_type", F.inline(sides))
    away = F.col("side") == "outgoing"
    rules = _rule_frame(graph)
    return (
        ends.join(kinds, "urn")
        .join(F.broadcast(rules), ["side", "node_type"])  # a fixed rule table of two rows per node type
        .filter(~F.array_contains("allowed", F.col("edge_type")))
        .select(
            "uuid", "edge_type", F.when(away, F.col("urn")).otherwise(F.col("other")).alias("from_urn"),
            F.when(away, F.col("other")).otherwise(F.col("urn")).alias("to_urn"), "side", "node_type",
        )
    )
