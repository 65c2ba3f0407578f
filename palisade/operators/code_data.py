"""Questions joining code to data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions import labels, meta
from palisade.model import CODE_TO_DATA, Graph
from palisade.operators.traverse import weak_components


def tables_by_name(graph: Graph) -> DataFrame:
    """``(table_name, urn)``: of several tables with one name the *last* discovered wins."""
    tables = graph.of_type("table")
    named = tables.select(meta.get(tables, "table_name").alias("table_name"), "urn", "ord")
    return (
        named.filter("table_name <> ''")
        .groupBy("table_name")
        .agg(F.max_by("urn", F.struct("ord", "urn")).alias("urn"))
    )


def _table_named(graph: Graph, name: str) -> DataFrame:
    tables = graph.of_type("table")
    chosen = tables.filter(meta.get(tables, "table_name") == name)
    return chosen.agg(F.max_by("urn", F.struct("ord", "urn")).alias("urn")).filter("urn is not null")


def _access_edges(graph: Graph) -> DataFrame:
    edges = graph.edges_of(*CODE_TO_DATA)
    return edges.select(
        "from_urn", "to_urn", "edge_type",
        F.coalesce(meta.get(edges, "detection_method"), F.lit("")).alias("method"),
        meta.get(edges, "confidence").alias("confidence"),
        meta.get(edges, "referenced_model").alias("referenced_model"),
    )


def _code(graph: Graph) -> DataFrame:
    nodes = graph.nodes
    return nodes.select(
        F.col("urn").alias("from_urn"), "node_type",
        meta.get(nodes, "function_name").alias("function_name"),
        meta.get(nodes, "class_name").alias("class_name"),
        meta.get(nodes, "file_path").alias("file_path"),
    )


def find_code_for_table(graph: Graph, table_name: str) -> DataFrame:
    """Code behind a table; ``section`` is models, functions or other (only counted)."""
    target = _table_named(graph, table_name).withColumnRenamed("urn", "to_urn")
    section = (
        F.when(F.col("method") == "orm_tablename", "models")
        .when(F.col("method") == "orm_reference", "functions")
        .otherwise("other")
    )
    return (
        _access_edges(graph)
        .join(target, "to_urn", "left_semi")
        .join(_code(graph), "from_urn", "left")
        .select(
            section.alias("section"), F.col("from_urn").alias("urn"), "edge_type",
            F.coalesce(F.when(section == "models", F.col("class_name")).otherwise(F.col("function_name")), F.lit("?")).alias("name"),
            F.coalesce("file_path", F.lit("?")).alias("file_path"), "confidence",
        )
    )


def find_tables_for_code(graph: Graph, name: str) -> DataFrame:
    """Tables a function or class of that exact name touches; a NULL table when none."""
    nodes = graph.of_type("function", "class")
    exact = F.when(F.col("node_type") == "function", meta.get(nodes, "function_name")).otherwise(meta.get(nodes, "class_name"))
    code = nodes.filter(exact == name).select(
        F.col("urn").alias("from_urn"), "node_type", labels.query_label(nodes).alias("label")
    )
    tables = graph.nodes
    names = tables.select(F.col("urn").alias("to_urn"), meta.get(tables, "table_name").alias("table_name"))
    touched = _access_edges(graph).join(names, "to_urn", "left").select(
        "from_urn", "edge_type", F.coalesce("table_name", F.lit("?")).alias("table_name"),
        F.coalesce(F.nullif("method", F.lit("")), F.lit("?")).alias("method"),
    )
    return code.join(touched, "from_urn", "left").select(
        F.col("from_urn").alias("urn"), "node_type", "label", "edge_type", "table_name", "method"
    )


def find_orphaned_tables(graph: Graph) -> DataFrame:
    """A3: tables no code reads, writes or models, with their foreign-key edge count."""
    tables = graph.of_type("table")
    referenced = graph.edges_of(*CODE_TO_DATA).select(F.col("to_urn").alias("urn"))
    orphans = tables.select(
        "urn", F.coalesce(meta.get(tables, "schema_name"), F.lit("?")).alias("schema_name"),
        F.coalesce(meta.get(tables, "table_name"), F.lit("?")).alias("table_name"),
    ).join(referenced, "urn", "left_anti")
    links = graph.edges_of("references", "soft_reference").select(F.explode(F.array("from_urn", "to_urn")).alias("urn"))
    fk = links.groupBy("urn").agg(F.count("*").alias("fk_edges"))
    return orphans.join(fk, "urn", "left").withColumn("fk_edges", F.coalesce("fk_edges", F.lit(0)).cast("bigint"))


def table_access(graph: Graph, table_name: str = "") -> DataFrame:
    """A2: one row per access of a table: ORM model or function, in long form.

    Long form on purpose: a table touched by a third of all code would not fit
    in one row.  :func:`table_access_counts` is its per-table roll-up.
    """
    tables = graph.of_type("table")
    targets = tables.select(F.col("urn").alias("to_urn"), F.coalesce(meta.get(tables, "table_name"), F.lit("?")).alias("table_name"))
    if table_name:
        targets = targets.filter(F.col("table_name") == table_name)
    is_model = F.col("method") == "orm_tablename"
    return (
        _access_edges(graph)
        .join(targets, "to_urn")
        .join(_code(graph), "from_urn")
        .select(
            "table_name", F.when(is_model, "model").otherwise("function").alias("kind"),
            F.col("from_urn").alias("urn"), "edge_type",
            F.coalesce(F.when(is_model, F.col("class_name")).otherwise(F.col("function_name")), F.lit("?")).alias("name"),
            F.coalesce("file_path", F.lit("?")).alias("file_path"),
            F.coalesce("referenced_model", F.lit("?")).alias("via_model"),
        )
    )


def table_access_counts(graph: Graph, table_name: str = "") -> DataFrame:
    """A2 roll-up: models and functions per table name, as rows of :func:`table_access`.

    Accesses are counted per table before the tables are looked up, so they move once, to their code,
    whose URNs are hashed there: URNs begin alike and are slow to sort.
    """
    tables = graph.of_type("table")
    targets = tables.select(F.col("urn").alias("to_urn"), F.coalesce(meta.get(tables, "table_name"), F.lit("?")).alias("table_name"))
    if table_name:
        targets = targets.filter(F.col("table_name") == table_name)
    accesses = _access_edges(graph).select("from_urn", "to_urn", (F.col("method") == "orm_tablename").alias("is_model"))
    if table_name:
        accesses = accesses.join(targets.select("to_urn"), "to_urn", "left_semi")
    counts = (
        accesses.join(graph.nodes.select(F.col("urn").alias("from_urn")).hint("shuffle_hash"), "from_urn")
        .groupBy("to_urn").agg(F.count_if("is_model").alias("models"), F.count_if(~F.col("is_model")).alias("functions"))
    )
    return counts.join(targets, "to_urn").groupBy("table_name").agg(F.sum("models").alias("models"), F.sum("functions").alias("functions"))


def find_data_hubs(graph: Graph, min_tables: int = 3, limit: int = 10) -> DataFrame:
    """Call clusters touching the most distinct table names.

    Code that touches data but calls nothing is a cluster of its own.
    """
    called = weak_components(graph)
    data = graph.edges_of(*CODE_TO_DATA).select(F.col("from_urn").alias("urn"), "to_urn")
    alone = data.select("urn").distinct().join(called, "urn", "left_anti")
    clusters = called.unionByName(alone.select("urn", F.col("urn").alias("component")))
    sizes = clusters.groupBy("component").agg(F.count("*").alias("members"))
    tables = graph.of_type("table")
    names = tables.select(
        F.col("urn").alias("to_urn"), F.coalesce(meta.get(tables, "table_name"), F.col("urn")).alias("table_name")
    )
    touched = (
        data.join(clusters, "urn")
        .join(names, "to_urn")
        .select("component", "table_name")
        .distinct()
        .groupBy("component")
        .agg(F.count("*").alias("tables"))
        .filter(F.col("tables") >= min_tables)
    )
    return touched.join(sizes, "component").orderBy(F.desc("tables"), "component").limit(limit)
