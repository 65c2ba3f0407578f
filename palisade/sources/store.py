"""The canonical store: versioned Parquet tables with changes merged on read (K1, K3, K5, K6, K7)."""

from __future__ import annotations

import time
import uuid
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import labels
from palisade.model import NODE_KEYS, SOFT_LINK_SCHEMA, Graph
from palisade.operators import mutate, soft_links
from palisade.operators.adjacency import Adjacency, write_links
from palisade.session import small_partitions, stash


class Sink(Protocol):
    """K5: what a place to keep graphs in must offer.  Changes come as frames, so one call may hold many."""

    def write(self, graph: Graph) -> str: ...

    def read(self, version: str | None = None) -> Graph: ...

    def update_node_metadata(self, patches: DataFrame) -> str: ...

    def delete_node_metadata(self, keys: DataFrame) -> str: ...

    def add_soft_links(self, requests: DataFrame) -> str: ...

    def remove_soft_links(self, ids: DataFrame) -> str: ...


_MARKER = "version string, generated_at timestamp, base string, keys array<string>"
_PATCHES = "urn string, key string, value string, seq bigint"
_LINKS = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in SOFT_LINK_SCHEMA.fields)}, gone boolean"
#: Stands for all keys outside the vocabulary in a marker.
_LOOSE = "*"


class ParquetStore:
    """Immutable versions under one folder; a version counts once its marker row is committed.

    A scan writes a *base*: nodes and edges by type, so questions about a type
    read only its folder, sorted by URN within, so point lookups skip row
    groups, and the links as searches follow them.  A change writes only itself, beside its base, and is a version
    too: metadata patches by URN and key, links and their tombstones by id.  Reading folds the changes up to the
    version into the base, the last one per key or id by ``max_by``; :meth:`compact` writes a new base.
    Readers keep their version; no lock is needed.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    # --- bases ---------------------------------------------------------------

    def write(self, graph: Graph) -> str:
        """K1/K3: write a new base; earlier versions and their readers are untouched.

        Soft links are carried over when the graph states none, so a re-scan
        does not lose them.
        """
        version = self._new_version()
        base = f"{self.folder}/{version}"
        links = graph.soft_links
        if links is None:
            links = self._links_or_empty()
        self._write_sorted(labels.settle_types(graph.nodes), "node_type", "urn", f"{base}/nodes")
        self._write_sorted(graph.edges, "edge_type", "from_urn", f"{base}/edges")
        # sorted edges are the links along the edge; those against it come from what was just written
        write_links(self.spark.read.schema("from_urn string, to_urn string, edge_type string").parquet(f"{base}/edges"), f"{base}/links", ("in",))
        links.write.option("compression", "zstd").parquet(f"{base}/soft_links")
        return self._commit(version, version, [])

    @staticmethod
    def _write_sorted(df: DataFrame, kind: str, key: str, path: str) -> None:
        """Sorted where the rows are computed: dealt by hash, each file would hold keys of the whole range as well, after one more shuffle of all there is."""
        with small_partitions(df.sparkSession):
            df.sortWithinPartitions(kind, key).write.partitionBy(kind).option("compression", "zstd").parquet(path)

    @staticmethod
    def _new_version() -> str:
        return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def _commit(self, version: str, base: str, keys: list[str]) -> str:
        marker = self.spark.range(1).select(
            F.lit(version).alias("version"), F.current_timestamp().alias("generated_at"), F.lit(base).alias("base"),
            F.array(*[F.lit(k) for k in keys]).cast("array<string>").alias("keys"),
        )
        marker.write.mode("append").parquet(f"{self.folder}/versions")
        return version

    def _markers(self) -> DataFrame:
        return self.spark.read.schema(_MARKER).parquet(f"{self.folder}/versions").withColumn("base", F.coalesce("base", "version"))

    def latest(self) -> str | None:
        try:
            row = self._markers().agg(F.max("version")).first()
        except AnalysisException:
            return None
        return row[0]

    # --- reading ---------------------------------------------------------------

    def read(self, version: str | None = None) -> Graph:
        version, base, changes, keys = self._state(version)
        root = f"{self.folder}/{base}"
        read = self.spark.read.parquet
        nodes, edges = read(f"{root}/nodes"), read(f"{root}/edges")
        links = self.spark.read.schema(SOFT_LINK_SCHEMA).parquet(f"{root}/soft_links")
        if keys:
            nodes = mutate.apply_patches(nodes, self._folded_patches(root, changes), keys)
        if changes:
            links = self._folded_links(root, links, changes)
        graph = Graph(nodes, edges, links)
        object.__setattr__(graph, "_adjacency", Adjacency.stored(self.spark, f"{root}/links", f"{root}/edges"))
        return graph

    def _state(self, version: str | None) -> tuple[str, str, list[str], list[str]]:
        """The version, its base, the changes it holds, and the metadata keys they touch."""
        version = version or self.latest()
        if version is None:
            raise FileNotFoundError(f"no graph in {self.folder}")
        markers = self._markers()
        own = markers.filter(F.col("version") == version).select("base").first()
        if own is None:
            raise FileNotFoundError(f"no version {version} in {self.folder}")
        # a base is compacted before its changes are many
        held = markers.filter((F.col("base") == own.base) & (F.col("version") <= version) & (F.col("version") > own.base)).select("version", "keys").collect()
        keys = sorted({k for m in held for k in m["keys"]})
        return version, own.base, sorted(m["version"] for m in held), keys

    def _change_rows(self, root: str, part: str, schema: str, changes: list[str]) -> DataFrame:
        """Rows of a part of the changes, with the change they are of; changes without that part have no folder."""
        rows = self.spark.read.schema(f"{schema}, change string").option("basePath", f"{root}/{part}").parquet(f"{root}/{part}")
        return rows.filter(F.col("change").isin(*changes))

    def _folded_patches(self, root: str, changes: list[str]) -> DataFrame:
        rows = self._change_rows(root, "patches", _PATCHES, changes)
        last = rows.groupBy("urn", "key").agg(F.max_by("value", F.struct("change", "seq")).alias("value"))
        return last.groupBy("urn").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("patch"))

    def _folded_links(self, root: str, links: DataFrame, changes: list[str]) -> DataFrame:
        try:
            rows = self._change_rows(root, "link_changes", _LINKS, changes)
        except AnalysisException:  # metadata was changed only
            return links
        own = SOFT_LINK_SCHEMA.fieldNames()
        every = links.withColumns({"gone": F.lit(False), "change": F.lit("")}).unionByName(rows)
        last = every.groupBy("id").agg(F.max_by(F.struct(*own, "gone"), "change").alias("x"))
        return last.select("x.*").filter("not gone").select(*own)

    # --- changes ---------------------------------------------------------------

    def _change(self, part: str, rows: DataFrame, keys: list[str]) -> str:
        _, base, _, _ = self._state(None)
        version = self._new_version()
        rows.write.option("compression", "zstd").parquet(f"{self.folder}/{base}/{part}/change={version}")
        return self._commit(version, base, keys)

    def update_node_metadata(self, patches: DataFrame) -> str:
        """M1: merge ``(urn, seq, patch)`` into node metadata; ``patch`` is a JSON object, a JSON null drops a key.

        The last ``seq`` per node and key wins.  Patches of nodes that are not there stay without effect.
        """
        entries = patches.select("urn", F.col("seq").cast("bigint").alias("seq"), F.explode(F.from_json("patch", "map<string,variant>")).alias("key", "v"))
        rows = entries.select("urn", "key", F.coalesce(F.to_json("v"), F.lit("null")).alias("value"), "seq")
        once = stash(rows.groupBy("urn", "key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq")), "patches")
        return self._change("patches", once, self._touched(once))

    def delete_node_metadata(self, keys: DataFrame) -> str:
        """M2: drop ``(urn, key)``; absent ones are ignored."""
        rows = stash(keys.select("urn", "key", F.lit("null").alias("value"), F.lit(0).cast("bigint").alias("seq")).distinct(), "patches")
        return self._change("patches", rows, self._touched(rows))

    @staticmethod
    def _touched(rows: DataFrame) -> list[str]:
        """Keys of the vocabulary, and a mark for any other: a bounded answer however many there are."""
        known = F.when(F.col("key").isin(*NODE_KEYS), F.col("key")).otherwise(_LOOSE)
        return sorted(r[0] for r in rows.select(known.alias("key")).distinct().collect())

    def add_soft_links(self, requests: DataFrame) -> str:
        """M3: add the acceptable requests; :func:`soft_links.check_links` says what is wrong with the others."""
        links = soft_links.accept_links(soft_links.check_links(self.read(), requests))
        return self._change("link_changes", links.withColumn("gone", F.lit(False)), [])

    def remove_soft_links(self, ids: DataFrame) -> str:
        """M5: drop links by ``id``; unknown ones are ignored."""
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in SOFT_LINK_SCHEMA.fields if f.name != "id"]
        return self._change("link_changes", ids.select("id").distinct().select("id", *none, F.lit(True).alias("gone")), [])

    def compact(self, changes: int = 1) -> str:
        """A new base if the last one has that many changes at least; the version to read."""
        version, _, held, _ = self._state(None)
        return self.write(self.read(version)) if len(held) >= changes else version

    def _links_or_empty(self) -> DataFrame:
        version = self.latest()
        if version is None:
            return self.spark.createDataFrame([], SOFT_LINK_SCHEMA)
        return self.read(version).soft_links


def save_candidates(candidates: DataFrame, folder: str, graph_version: str) -> None:
    """K6: candidates with the graph version they were found in; destination and path are kept."""
    candidates.withColumn("graph_version", F.lit(graph_version)).write.mode("overwrite").parquet(folder)


def with_status(candidates: DataFrame, updates: DataFrame) -> DataFrame:
    """K6: apply ``(id, seq, status)`` updates, the last per candidate wins."""
    last = updates.groupBy("id").agg(F.max_by("status", "seq").alias("_new"))
    return candidates.join(last, "id", "left").withColumn("status", F.coalesce("_new", "status")).select(*candidates.columns)


def report(outcomes: DataFrame) -> DataFrame:
    """K7: how many candidates ended in each outcome."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))
