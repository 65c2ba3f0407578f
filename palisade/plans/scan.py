"""The scan: ingest, stitch, resolve, enrich, validate, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palisade.model import Graph, union_all
from palisade.operators.enrich import enrich_sensitivity
from palisade.operators.stitch import resolve, stitch
from palisade.session import stash
from palisade.sources.dispatch import Target, load_with_sources
from palisade.sources.store import Sink


def ingest(spark: SparkSession, targets: list[Target]) -> tuple[Graph, DataFrame | None]:
    """Graphs of all targets, merged in target order, and ``(file_urn, source)`` of all source trees (None without one)."""
    loaded = [load_with_sources(spark, t) for t in targets]
    first, *rest = [graph for graph, _ in loaded]
    texts = [own for _, own in loaded if own is not None]
    return first.merge(*rest) if rest else first, union_all(texts) if texts else None


def assemble(graph: Graph, sources: DataFrame | None = None) -> Graph:
    """Stitch, resolve and enrich an ingested graph.

    The ingested graph is written once: twelve stitchers read it, and none
    should repeat the loaders' work.
    """
    ingested = Graph(stash(graph.nodes, "nodes"), stash(graph.edges, "edges"), graph.soft_links)
    linked = resolve(stitch(ingested, sources))
    return linked.with_nodes(enrich_sensitivity(linked.nodes))


def scan(spark: SparkSession, targets: list[Target], sink: Sink, sources: DataFrame | None = None) -> str:
    """Run a whole scan and return the version written; ``sources`` stands in for the targets' own texts."""
    graph, texts = ingest(spark, targets)
    return sink.write(assemble(graph, texts if sources is None else sources).validate())
