"""Code to data: ORM classes to tables (J1) and functions to tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions import meta, source_text
from palisade.model import Graph
from palisade.operators.stitch.common import index_by, new_edges
from palisade.session import stash, stash_counted


def orm_registry(graph: Graph) -> DataFrame:
    """``(class_name, class_urn, table_name)``: last ORM class of a name wins."""
    nodes = graph.nodes
    classes = nodes.select(
        meta.get(nodes, "class_name").alias("class_name"), meta.get(nodes, "orm_table").alias("orm_table"), "urn", "ord"
    ).filter("orm_table is not null")
    return (
        classes.groupBy("class_name")
        .agg(F.max_by(F.struct("urn", "orm_table", "ord"), F.struct("ord", "urn")).alias("c"))
        .select("class_name", F.col("c.urn").alias("class_urn"), F.col("c.orm_table").alias("table_name"), F.col("c.ord").alias("ord"))
    )


def _tables(graph: Graph) -> DataFrame:
    return index_by(graph.nodes, "table_name", "table_urn")


def orm_class_to_table(graph: Graph) -> DataFrame:
    """``models`` edges; table names first-wins, class names last-wins."""
    linked = orm_registry(graph).join(_tables(graph), "table_name")
    return new_edges(
        linked, "models", 1, "class_urn", "table_urn", F.col("ord"),
        detection_method="orm_tablename", confidence=1.0, orm_framework="sqlalchemy",
        orm_class=F.col("class_name"), table_name=F.col("table_name"),
    )


#: Names of one automaton: some tens of MB in each task.
SHARD = 300_000


def names_within(texts: DataFrame, names: DataFrame, shard: int = SHARD) -> DataFrame:
    """``(id, name)`` for every ``name`` that is a substring of a text, without a cross join.

    The dictionary is cut at first characters into ranges of some ``shard`` names.  Each range is one
    automaton of all its names (Aho-Corasick), built once a task, and every text streams through it
    once, whatever the number of names; so no task and not the driver holds more than one range, and
    nothing is shuffled.  A text gives each name once, however often it holds it.

    ``texts``: ``id, text``; ``names``: ``name`` (distinct, not empty).  Further columns of either come along,
    those of names by a broadcast of one range.
    """
    held, _, size = stash_counted(names, "names")
    ranges = max(1, -(-size // shard))
    if ranges > 1:
        held = stash(held.repartitionByRange(ranges, "name").select("*", F.spark_partition_id().alias("range")), "names")
    carried = [c for c in texts.columns if c != "text"]
    schema = T.StructType([*[texts.schema[c] for c in carried], T.StructField("names", T.ArrayType(T.StringType()))])
    columns = [*carried, *names.columns]
    found = []
    for k in range(ranges):
        own = held if ranges == 1 else held.filter(F.col("range") == k).drop("range")
        listed = [r[0] for r in own.select("name").collect()]  # one range
        if listed:
            hits = texts.select(*carried, "text").mapInArrow(_searcher(listed), schema).select(*carried, F.explode("names").alias("name"))
            found.append((hits.join(F.broadcast(own), "name") if len(names.columns) > 1 else hits).select(*columns))
    return reduce(DataFrame.unionAll, found) if found else texts.limit(0).select(*carried, F.lit("").alias("name")).join(held, "name").select(*columns)


def _searcher(names: list[str]):
    """Batches of texts and further columns to batches of those columns and the list of names found, without texts that hold none."""

    def search(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for name in names:
            automaton.add_word(name, name)
        automaton.make_automaton()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                places, found = [], []
                for place, text in enumerate(part.column("text").to_pylist()):
                    own = {name for _, name in automaton.iter(text)} if text else None
                    if own:
                        places.append(place)
                        found.append(list(own))
                if places:
                    kept = part.select([c for c in part.schema.names if c != "text"]).take(pa.array(places, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.list_(pa.string()))], [*kept.schema.names, "names"])

    return search


def function_to_table(graph: Graph, sources: DataFrame | None = None) -> DataFrame:
    """``reads`` edges from functions whose text contains an ORM class name.

    ``sources`` is ``(file_path, source)`` of one tree or ``(file_urn, source)`` of
    several; a function's text is its line range.
    """
    if sources is None:
        return orm_class_to_table(graph).limit(0)
    nodes = graph.nodes
    functions = nodes.select(
        "urn", "ord", meta.get(nodes, "function_name").alias("f"), meta.get(nodes, "file_path").alias("file_path"),
        meta.get(nodes, "start_line").alias("start"), meta.get(nodes, "end_line").alias("end"),
    ).filter("f is not null and file_path <> '' and start is not null and end is not null")
    if "file_urn" in sources.columns:
        functions = functions.withColumn("file_urn", F.expr("left(urn, locate(concat('/', file_path, '/'), urn) + length(file_path))"))
        sources, key = sources.select("file_urn", "source"), "file_urn"
    else:
        key = "file_path"
    texts = functions.join(sources, key).select(
        F.col("urn").alias("id"), "ord", source_text.lines_between(F.col("source"), F.col("start"), F.col("end")).alias("text")
    ).filter("text <> ''")
    return function_texts_to_tables(graph, texts)


def function_texts_to_tables(graph: Graph, texts: DataFrame) -> DataFrame:
    """J2 core over ``(id, ord, text)``, one row per function."""
    registry = orm_registry(graph).filter("class_name <> ''").drop("ord").join(_tables(graph), "table_name").withColumnRenamed("class_name", "name")
    texts = texts.filter("id is not null")
    found = names_within(texts.select("id", "ord", "text"), registry)
    # rows that share an id give each other's ordinals too; as a rule there are none
    shared = texts.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    ordinals = stash(texts.select("id", F.struct("ord").alias("each")).join(shared, "id", "left_semi"), "shared")
    linked = found.join(ordinals, "id", "left").withColumn("ord", F.when(F.col("each").isNotNull(), F.col("each.ord")).otherwise(F.col("ord")))
    linked = linked.withColumnRenamed("id", "function_urn")
    return new_edges(
        linked, "reads", 2, "function_urn", "table_urn", F.col("ord"),
        detection_method="orm_reference", confidence=0.9, referenced_model=F.col("name"), table_name=F.col("table_name"),
    )
