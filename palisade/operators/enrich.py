"""Sensitivity enrichment of nodes (F6) and roll-up onto parent tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import meta, scalars


def _own_tags(nodes: DataFrame) -> Column:
    """Tags of the node itself; object-path tags replace column tags."""
    column, path = meta.get(nodes, "column_name"), meta.get(nodes, "path_pattern")
    none = F.array().cast("array<string>")
    return (
        F.when(meta.truthy(nodes, "path_pattern"), scalars.path_tags(path))
        .when(meta.truthy(nodes, "column_name"), scalars.column_tags(column))
        .otherwise(none)
    )


def _csv(column: Column) -> Column:
    return F.split(column, ",")


def enrich_sensitivity(nodes: DataFrame) -> DataFrame:
    """Set ``data_sensitivity`` on columns, object paths and the tables holding them.

    First-time tags keep pattern order; once merged with earlier tags the set is
    sorted.  The roll-up unions *sets*: tags are exploded and deduplicated by
    the aggregate, so a table with very many columns never becomes one long array.
    """
    existing = meta.get(nodes, "data_sensitivity")
    had = F.coalesce(existing != "", F.lit(False))
    fresh = F.col("_tags")
    merged = F.when(had, F.array_sort(F.array_union(_csv(existing), fresh))).otherwise(fresh)
    first = (
        nodes.withColumn("_tags", _own_tags(nodes))
        .withColumn("_final", F.when(F.size(fresh) > 0, merged))
    )
    inherited = (
        first.filter("_final is not null and parent_urn is not null")
        .select(F.col("parent_urn").alias("urn"), F.explode("_final").alias("tag"))
        .groupBy("urn")
        .agg(F.array_sort(F.collect_set("tag")).alias("_inherited"))
    )
    own = F.coalesce(F.array_join("_final", ","), existing)
    joined = first.withColumn("_own", own).join(inherited, "urn", "left")
    rolled = F.when(
        F.coalesce(F.col("_own") != "", F.lit(False)),
        F.array_sort(F.array_union(F.col("_inherited"), _csv(F.col("_own")))),
    ).otherwise(F.col("_inherited"))
    is_parent = F.col("_inherited").isNotNull() & meta.present(nodes, "table_name")
    value = F.when(is_parent, F.array_join(rolled, ",")).otherwise(F.col("_own"))
    return joined.withColumn("metadata", F.col("metadata").withField("data_sensitivity", value)).select(
        *nodes.columns
    )
