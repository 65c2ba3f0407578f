"""Following changes with Structured Streaming.

The graph itself is immutable; users append requests (metadata patches, link
requests) to a log folder.  A stream over the log writes each micro-batch as a change
of the store, which replaces polling a file and reloading it, and reads no more of
the graph than the batch needs; every ``COMPACT_AFTER`` changes become a new base.  There are
no windows, watermarks or late data to handle: a batch is applied in ``seq``
order and replays are harmless because ids are derived from content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from palisade.sources.store import ParquetStore

PATCH_LOG = "urn string, seq bigint, patch string"
LINK_LOG = "from_urn string, to_urn string, edge_type string, confidence_level string, note string, created_at string"


#: Changes of a base that are folded on every read before they are written into a new one.
COMPACT_AFTER = 64


def apply_patch_batch(store: ParquetStore, batch: DataFrame) -> str | None:
    """One batch of ``(urn, seq, patch)``: shallow merges into node metadata, as a new version."""
    if batch.isEmpty():
        return None
    store.update_node_metadata(batch)
    return store.compact(COMPACT_AFTER)


def apply_link_batch(store: ParquetStore, batch: DataFrame) -> str | None:
    """One batch of link requests; unacceptable ones are dropped, known ones not repeated."""
    if batch.isEmpty():
        return None
    store.add_soft_links(batch)
    return store.compact(COMPACT_AFTER)


def follow(spark: SparkSession, store: ParquetStore, log: str, checkpoint: str, kind: str = "patch", **trigger) -> StreamingQuery:
    """Stream a log folder of JSON lines into the store."""
    schema, fold = {"patch": (PATCH_LOG, apply_patch_batch), "link": (LINK_LOG, apply_link_batch)}[kind]
    events = spark.readStream.schema(schema).json(log)
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: fold(store, batch))
    return writer.trigger(**(trigger or {"availableNow": True})).start()
