"""Node labels and type inference (Q5-Q9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import meta, urn

# --- fixed values: name keys in the order labels try them ---------------------
QUERY_LABEL_KEYS = (
    "function_name class_name column_name table_name schema_name repo_name database_name"
).split()
SECURITY_LABEL_KEYS = (
    "function_name class_name table_name column_name path_pattern role_name"
).split()


def query_label(df: DataFrame) -> Column:
    """Q5: first *present* name, else the file's base name, else the URN's tail."""
    names = [meta.get(df, k) for k in QUERY_LABEL_KEYS]
    return F.coalesce(*names, urn.tail(meta.get(df, "file_path")), urn.tail(F.col("urn")))


def security_label(df: DataFrame) -> Column:
    """Q6: first *truthy* name, else the URN."""
    return F.coalesce(*[F.nullif(meta.get(df, k), F.lit("")) for k in SECURITY_LABEL_KEYS], F.col("urn"))


def code_label(df: DataFrame) -> Column:
    """Q7: ``name in path`` with ``?`` for what is missing."""
    name = F.coalesce(
        F.nullif(meta.get(df, "function_name"), F.lit("")), meta.get(df, "class_name"), F.lit("?")
    )
    return F.concat(name, F.lit(" in "), F.coalesce(meta.get(df, "file_path"), F.lit("?")))


def classify(df: DataFrame) -> Column:
    """Q8: node type inferred from the keys present, first rule wins."""
    has = lambda k: meta.present(df, k)
    s3 = (
        F.when(has("partition_type"), "s3_partition")
        .when(~has("object_count"), "s3_prefix")
        .otherwise("s3_object")
    )
    return (
        F.when(has("function_name"), "function")
        .when(has("class_name"), "class")
        .when(has("column_name"), "column")
        .when(has("table_name"), "table")
        .when(has("schema_name"), "schema")
        .when(has("repo_name"), "codebase")
        .when(has("file_path"), "file")
        .when(has("database_name"), "database")
        .when(has("path_pattern"), s3)
        .when(has("bucket_name"), "s3_bucket")
        .when(has("package_manager"), "package_manifest")
        .when(has("package_name"), "dependency")
        .when(has("role_name"), "db_role")
        .otherwise("unknown")
    )


def settle_types(nodes: DataFrame) -> DataFrame:
    """K2: infer the type of nodes whose type is ``unknown`` (or missing)."""
    open_type = F.coalesce(F.col("node_type"), F.lit("unknown")) == "unknown"
    return nodes.withColumn("node_type", F.when(open_type, classify(nodes)).otherwise(F.col("node_type")))


def edge_namespace(edge_type: Column) -> Column:
    """Q9: text before the first colon, NULL when there is none."""
    return F.when(edge_type.contains(":"), F.substring_index(edge_type, ":", 1))
