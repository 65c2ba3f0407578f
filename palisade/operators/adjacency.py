"""Stored adjacency: the links of one graph version as tables that every search reads.

A row is an edge seen from one of its ends, ``(src, dst)``, below folders ``way`` (``out`` along
the edge, ``in`` against it) and ``edge_type``, sorted by ``src``.  Ids are left with the edges: texts of 36 random
digits would be more than half of what is shuffled and written, and only the arrows of a path need some.
A search reads the folders of the types and
directions it follows.  A small frontier is handed to the scan as values, so row groups and pages without
them are skipped; a larger one is joined, broadcast if its written size allows, else shuffled with the links
that leave it, which a broadcast set of its hashes picks out, and AQE splits a vertex that holds much of the edges.
Links are sorted in the tasks that compute them, not dealt anew: a hub is spread over several files, which buckets by ``src`` could not do.

A store's edges are sorted by the end they leave, so they are the links along the edge; it writes those against the
edge with each version.  For a graph that is computed, a type's links are written when a
search first follows it, and kept for the graph's ``version`` while the application lives.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.model import Graph, union_all
from palisade.session import shared_folder, small_partitions

WAYS = {"outgoing": ("out",), "incoming": ("in",), "both": ("out", "in")}
#: Vertices that are handed to a scan as values.
FEW = 64
#: Vertices whose hashes are broadcast, some tens of MB, to pick out their links before a shuffle.
SOME = 2 << 20
_SCHEMA = "src string, dst string, way string, edge_type string"
_EDGES = "from_urn string, to_urn string, edge_type string"
#: Adjacencies of computed graphs by application and graph version.
_KEPT: dict[tuple[str, str], Adjacency] = {}


class Adjacency:
    def __init__(self, spark: SparkSession, folder: str, graph: Graph | None = None):
        self.spark, self.folder, self.graph = spark, folder, graph
        #: Types (None: all there are), ways and place of what is written.
        self.parts: list[tuple[frozenset[str] | None, tuple[str, ...], str]] = []
        self.more: list[DataFrame] = []
        #: Where a store keeps its edges, if it is one's.
        self.edges_at: str | None = None

    @classmethod
    def stored(cls, spark: SparkSession, path: str, edges: str) -> Adjacency:
        """The tables of all types that a store has written: links against the edge, and its sorted edges."""
        self = cls(spark, path)
        self.parts += [(None, ("in",), path), (None, ("out",), edges)]
        self.edges_at = edges
        return self

    def plus(self, edges: DataFrame) -> Adjacency:
        """These links and those of further edges, of which there are few; they are written at the first search."""
        both = Adjacency(self.spark, f"{shared_folder(self.spark)}/links-{uuid.uuid4().hex}", self.graph)
        both.parts, both.more, both.edges_at = [*self.parts], [*self.more, edges], self.edges_at
        return both

    def links(self, types: list[str] | None, direction: str) -> DataFrame:
        """``(src, dst, way, edge_type)`` of the types (all, if None), from both ends if ``both``."""
        if direction not in WAYS:
            raise ValueError(f"direction must be outgoing, incoming or both, not {direction!r}")
        known = None if self.graph is None else self.graph.edge_types()
        wanted = None if types is None else frozenset(types)
        if known is not None:
            wanted = frozenset(known) if wanted is None else wanted.intersection(known)
        ways = WAYS[direction]
        frames = [self._rows(path, wanted, ways) for held, path in self._missing_written(wanted, ways) if held is None or held & wanted]
        return union_all(frames) if frames else self.spark.createDataFrame([], _SCHEMA)

    def _rows(self, path: str, wanted: frozenset[str] | None, ways: tuple[str, ...]) -> DataFrame:
        if path == self.edges_at:
            edges = self.spark.read.schema(_EDGES).parquet(path)
            rows = edges.select(F.col("from_urn").alias("src"), F.col("to_urn").alias("dst"), F.lit("out").alias("way"), "edge_type")
        else:
            rows = self.spark.read.schema(_SCHEMA).parquet(path).filter(F.col("way").isin(*ways))
        return rows if wanted is None else rows.filter(F.col("edge_type").isin(*sorted(wanted)))

    def _missing_written(self, wanted: frozenset[str] | None, ways: tuple[str, ...]) -> list[tuple[frozenset[str] | None, str]]:
        """All parts that hold ``wanted`` types (None: all) and ``ways``, after writing what none holds."""
        for edges in self.more:
            self.parts.append((None, WAYS["both"], self._written(edges, WAYS["both"])))
        self.more = []
        if self.graph is not None:
            lacking: dict[frozenset[str] | None, list[str]] = {}
            for way in ways:
                own = [held for held, of, _ in self.parts if way in of]
                if None not in own:
                    missing = None if wanted is None else wanted.difference(*own)
                    if missing is None or missing:
                        lacking.setdefault(missing, []).append(way)
            for missing, of in lacking.items():
                if missing is None:  # types are not known, so those that were written alone are written again with all
                    self.parts = [(held, tuple(w for w in had if w not in of), path) for held, had, path in self.parts]
                edges = self.graph.edges if missing is None else self.graph.edges_of(*sorted(missing))
                self.parts.append((missing, tuple(of), self._written(edges, tuple(of))))
        return [(held, path) for held, of, path in self.parts if set(of) & set(ways)]

    def _written(self, edges: DataFrame, ways: tuple[str, ...]) -> str:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        write_links(edges, path, ways)
        return path


def write_links(edges: DataFrame, path: str, ways: tuple[str, ...] = ("out", "in")) -> None:
    """The ends of each edge, sorted by the end within way and type."""
    ends = {
        "out": F.struct(F.col("from_urn").alias("src"), F.col("to_urn").alias("dst"), F.lit("out").alias("way")),
        "in": F.struct(F.col("to_urn").alias("src"), F.col("from_urn").alias("dst"), F.lit("in").alias("way")),
    }
    rows = edges.select("edge_type", F.inline(F.array(*[ends[w] for w in ways]))).select("src", "dst", "way", "edge_type")
    with small_partitions(edges.sparkSession):
        rows.sortWithinPartitions("way", "edge_type", "src").write.partitionBy("way", "edge_type").option("compression", "zstd").parquet(path)


def adjacency_of(graph: Graph) -> Adjacency:
    """The adjacency of a graph: of its store, of its version, or of this object."""
    own = graph.__dict__.get("_adjacency")
    if own is None:
        spark, version = graph.spark, graph.version()
        key = (spark.sparkContext.applicationId, version)
        own = _KEPT.get(key) if version else None
        if own is None:
            own = Adjacency(spark, f"{shared_folder(spark)}/links-{uuid.uuid4().hex}", graph)
            if version:
                _KEPT[key] = own
        object.__setattr__(graph, "_adjacency", own)
    return own


def next_to(links: DataFrame, frontier: DataFrame, few: list[str] | None, size: int = 0) -> DataFrame:
    """Links that leave a frontier ``(src, ...)`` of at most ``size`` rows (0: not known), with the frontier's columns; ``few`` are its vertices if they are few."""
    if few is not None:
        links = links.filter(F.col("src").isin(*few))
    elif 0 < size <= SOME:
        keys = frontier.select(F.xxhash64("src").alias("_key")).distinct()
        # the join below compares the vertices themselves
        links = links.withColumn("_key", F.xxhash64("src")).join(F.broadcast(keys), "_key", "left_semi").drop("_key")
    elif size > SOME:
        # links, of which there are far more, are looked up as they come, not sorted
        frontier = frontier.hint("shuffle_hash")
    return links.join(frontier, "src")


def measured(frontier: DataFrame) -> tuple[int, list[str] | None]:
    """Rows of a written frontier ``(urn, ...)``, and its vertices if they are few."""
    some = [r[0] for r in frontier.select("urn").limit(FEW + 1).collect()]
    return (len(some), sorted(set(some))) if len(some) <= FEW else (frontier.count(), None)


__all__ = ["Adjacency", "adjacency_of", "measured", "next_to", "write_links"]
