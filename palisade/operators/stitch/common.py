"""Shared pieces of the stitchers: "wins" lookups and edge building."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import ids, meta
from palisade.model import DEFAULT_ORG, Graph

Stitcher = Callable[[Graph], DataFrame]

#: Ordinals have 48 bits.  A stitcher's edges stay within a band of their own, which has room for two
#: runs of ordinals: edges that come after all others of their stitcher start at ``LATER``.
LATER = 1 << 48
STEP = 1 << 49


def new_edges(df: DataFrame, kind: str, rank: int, src: str, dst: str, ordinal: Column, **metadata) -> DataFrame:
    """Edges in the canonical schema from a frame of endpoint columns."""
    ends = df.select(
        F.col(src).alias("from_urn"),
        F.col(dst).alias("to_urn"),
        (F.lit(rank * STEP) + ordinal.cast("bigint")).alias("ord"),
        meta.pack(**metadata).alias("metadata"),
    )
    return ends.select(
        F.expr(ids.edge_id_sql("from_urn", "to_urn", kind)).alias("uuid"),
        F.lit(DEFAULT_ORG).alias("organization_id"),
        "from_urn",
        "to_urn",
        F.lit(kind).alias("edge_type"),
        "metadata",
        "ord",
    )


def first_by(df: DataFrame, key: str, value: str, order: str = "ord") -> DataFrame:
    """``(key, value)``: the first row of each key wins."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(value, order).alias(value))


def last_by(df: DataFrame, keys: list[str], value: str, order: Column | str = "ord") -> DataFrame:
    """``(keys, value)``: the last row of each key wins."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def index_by(nodes: DataFrame, key: str, name: str = "urn") -> DataFrame:
    """Metadata value -> URN over nodes of *any* type, first occurrence wins."""
    found = nodes.select(meta.get(nodes, key).alias(key), F.col("urn").alias(name), "ord")
    return first_by(found, key, name)


__all__ = ["LATER", "STEP", "Stitcher", "first_by", "index_by", "last_by", "new_edges"]
