"""Graph documents and JSON lines.

The document form (one JSON object with ``nodes``, ``edges`` and ``soft_links``
lists) is for exchange; it is read and written in parallel where its layout
allows.  The canonical store is ``sources/store.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import labels
from palisade.model import EDGE_KEYS, NODE_KEYS, SOFT_LINK_SCHEMA, Graph
from palisade.session import small_partitions, stash
from palisade.sources.json_ranges import RANGE, elements_of, lists_of, ranges

_ITEM = "urn string, organization_id string, parent_urn string, node_type string, metadata variant"
_EDGE = "uuid string, organization_id string, from_urn string, to_urn string, edge_type string, metadata variant"
_LINK = "id string, from_urn string, to_urn string, edge_type string, detection_method string, confidence double, confidence_level string, note string, created_at string"


def typed_metadata(df: DataFrame, vocabulary: dict[str, str], keys: list[str]) -> DataFrame:
    """Turn a VARIANT bag into the metadata struct of ``keys`` and an ``extra`` map for the rest."""
    bag = F.col("metadata")
    fields = [F.try_variant_get(bag, f"$.{k}", vocabulary[k]).alias(k) for k in keys]
    others = F.map_filter(F.try_variant_get(bag, "$", "map<string,variant>"), lambda k, v: ~k.isin(*keys))
    extra = F.transform_values(others, lambda k, v: F.to_json(v))
    packed = F.struct(*fields) if fields else F.struct(F.lit(None).cast("string").alias("detection_method"))
    return df.withColumns({"extra": F.when(F.size(extra) > 0, extra), "metadata": packed})


def used_keys(df: DataFrame, vocabulary: dict[str, str]) -> list[str]:
    """Vocabulary keys that occur in a VARIANT bag: one distributed pass, a bounded answer."""
    keys = df.select(F.explode(F.map_keys(F.try_variant_get("metadata", "$", "map<string,variant>"))).alias("k"))
    found = {r["k"] for r in keys.filter(F.col("k").isin(list(vocabulary))).distinct().collect()}
    return [k for k in vocabulary if k in found]


def from_rows(nodes: DataFrame, edges: DataFrame, links: DataFrame | None = None, node_keys: list[str] | None = None, edge_keys: list[str] | None = None) -> Graph:
    """A graph from frames whose ``metadata`` is a VARIANT.

    Types missing or ``unknown`` are inferred; the keys in use are found by one
    pass unless given.
    """
    node_keys = used_keys(nodes, NODE_KEYS) if node_keys is None else node_keys
    edge_keys = used_keys(edges, EDGE_KEYS) if edge_keys is None else edge_keys
    typed = labels.settle_types(typed_metadata(nodes, NODE_KEYS, node_keys))
    return Graph(typed, typed_metadata(edges, EDGE_KEYS, edge_keys).withColumn("edge_type", F.coalesce("edge_type", F.lit("unknown"))), links)


def load_document(spark: SparkSession, path: str, range_bytes: int = RANGE) -> Graph:
    """A whole graph document, in one file or in the parts that :func:`write_document` leaves, read by byte ranges.

    Any layout will do.  Elements that are no objects of their kind are left out.  The ordinal of an item is its place in bytes.
    """
    cut = stash(ranges(spark, path, range_bytes), "ranges")
    lists = dict(sorted(((r["text"], r["place"]) for r in lists_of(cut).collect()), key=lambda x: x[1]))  # keys of the top object
    ends = sorted(lists.values())

    def part(name: str, ddl: str, *more: Column) -> DataFrame:
        start = lists.get(name)
        end = next((e for e in ends if start is not None and e > start), None)
        inside = F.lit(False) if start is None else F.col("base") + F.col("start") + F.col("n") > start
        inside = inside if end is None else inside & (F.col("base") + F.col("start") < end)
        own = elements_of(cut.filter(inside)).filter("kind = 'element'").filter(F.lit(False) if start is None else F.col("place") > start)
        own = own if end is None else own.filter(F.col("place") < end)
        return own.select(F.from_json("text", ddl).alias("x"), F.col("place").alias("ord")).filter("x is not null").select("x.*", *more)

    return from_rows(part("nodes", _ITEM, F.col("ord")), part("edges", _EDGE, F.col("ord")), part("soft_links", _LINK))


def load_indented(spark: SparkSession, path: str) -> Graph:
    """S1 in parallel: a document written with an indent of two, as scans write it.

    List items then start on a line of their own, so the text reader can cut the
    file at item starts and spread it over tasks.  The ordinal is the place of
    the item: the offset of its split, then its place within the split.
    """
    items = spark.read.option("lineSep", "\n    {\n").text(path)
    place = F.col("_metadata.file_block_start") * (1 << 24) + F.monotonically_increasing_id().bitwiseAND((1 << 24) - 1)
    body = F.concat(F.lit("{"), F.regexp_extract("value", r"(?s)^(.*?)\n    \}", 1), F.lit("}"))
    parsed = items.select(place.alias("ord"), F.try_parse_json(body).alias("v")).filter("v is not null")
    text = lambda k: F.try_variant_get("v", f"$.{k}", "string").alias(k)
    bag = F.coalesce(F.try_variant_get("v", "$.metadata", "variant"), F.parse_json(F.lit("{}"))).alias("metadata")
    has = lambda k: F.try_variant_get("v", f"$.{k}", "variant").isNotNull()
    nodes = parsed.filter(has("urn")).select(text("urn"), text("organization_id"), text("parent_urn"), text("node_type"), bag, "ord")
    edges = parsed.filter(has("uuid")).select(text("uuid"), text("organization_id"), text("from_urn"), text("to_urn"), text("edge_type"), bag, "ord")
    links = parsed.filter(has("id") & has("from_urn")).select(
        *[F.try_variant_get("v", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in SOFT_LINK_SCHEMA.fields]
    )
    return from_rows(nodes, edges, links)


def load_lines(spark: SparkSession, folder: str) -> Graph:
    """S1 for JSON lines: ``nodes``, ``edges`` and ``soft_links`` folders, one item per line with its ``ord``."""
    nodes = spark.read.schema(_ITEM + ", ord bigint").json(f"{folder}/nodes")
    edges = spark.read.schema(_EDGE + ", ord bigint").json(f"{folder}/edges")
    links = spark.read.schema(_LINK).json(f"{folder}/soft_links")
    return from_rows(nodes, edges, links)


def bag_json(df: DataFrame) -> Column:
    """Metadata as one JSON object text; absent keys are left out, ``extra`` is merged in."""
    known = F.to_json("metadata")
    if "extra" not in df.columns:
        return known
    pairs = F.array_join(F.transform(F.map_entries("extra"), lambda e: F.concat(F.to_json(e["key"].cast("variant")), F.lit(":"), e["value"])), ",")
    glue = F.when(known == "{}", F.lit("")).otherwise(F.lit(","))
    return F.when(F.size("extra") > 0, F.concat(F.expr("substr(to_json(metadata), 1, length(to_json(metadata)) - 1)"), glue, pairs, F.lit("}"))).otherwise(known)


def _item_json(df: DataFrame, names: list[str]) -> Column:
    flat = F.to_json(F.struct(*names))
    return F.concat(F.substring(flat, 1, 1), F.lit('"metadata": '), bag_json(df), F.when(F.length(flat) > 2, F.lit(", ")).otherwise(""), F.expr(f"substr(to_json(struct({', '.join(names)})), 2)"))


def write_lines(graph: Graph, folder: str) -> None:
    """K1: one JSON item per line, written by all tasks."""
    nodes, edges = labels.settle_types(graph.nodes), graph.edges
    nodes.select(_item_json(nodes, ["urn", "organization_id", "parent_urn", "node_type", "ord"]).alias("value")).write.mode("overwrite").text(f"{folder}/nodes")
    edges.select(_item_json(edges, ["uuid", "organization_id", "from_urn", "to_urn", "edge_type", "ord"]).alias("value")).write.mode("overwrite").text(f"{folder}/edges")
    links = graph.soft_links if graph.soft_links is not None else graph.spark.createDataFrame([], SOFT_LINK_SCHEMA)
    links.write.mode("overwrite").json(f"{folder}/soft_links")


#: Ids that 16 bytes stand for while lines are written and shuffled: their digits are most of what does not compress.
_UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"


def _uuid_text() -> Column:
    digits = F.lower(F.hex("id"))
    return F.concat_ws("-", *[F.substring(digits, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _edge_rows(edges: DataFrame) -> DataFrame:
    """The texts before and after the id of each edge, if it is a UUID; the text of any other is all in front."""
    names, short = ["uuid", "organization_id", "from_urn", "to_urn", "edge_type"], F.coalesce(F.col("uuid").rlike(_UUID), F.lit(False))
    rest = F.to_json(F.struct(*names[1:]))
    return edges.select(
        F.lit(3).alias("section"), "ord", F.when(short, F.unhex(F.replace("uuid", F.lit("-")))).alias("id"),
        F.when(short, F.concat_ws("|", "from_urn")).otherwise(F.concat_ws("|", "uuid", "from_urn")).alias("tie"),
        F.when(short, F.concat(F.lit('{"metadata": '), bag_json(edges), F.lit(", "))).otherwise(_item_json(edges, names)).alias("front"),
        F.when(short, F.concat(F.when(rest == "{}", "").otherwise(","), F.expr(f"substr(to_json(struct({', '.join(names[1:])})), 2)"))).otherwise("").alias("rest"),
    )


def write_document(graph: Graph, folder: str, generated_at: str, compression: str | None = None) -> None:
    """K1: the graph document as text parts which, put together in name order, are one JSON object.

    Lines are range-partitioned by section and place, so no task ever holds a
    whole list; each item but the first of its section is preceded by a comma.  They are
    written once before, as their ranges, their number and the first ones are asked for.
    With ``compression`` (``gzip`` or ``bzip2``) each part is a compressed file, and so are the parts put together.
    """
    nodes, edges = labels.settle_types(graph.nodes), graph.edges
    links = graph.soft_links if graph.soft_links is not None else graph.spark.createDataFrame([], SOFT_LINK_SCHEMA)
    no_id, no_rest = F.lit(None).cast("binary").alias("id"), F.lit("").alias("rest")
    rows = [
        nodes.select(F.lit(1).alias("section"), "ord", no_id, F.col("urn").alias("tie"), _item_json(nodes, ["urn", "organization_id", "parent_urn", "node_type"]).alias("front"), no_rest),
        _edge_rows(edges),
        links.select(F.lit(5).alias("section"), F.lit(0).cast("bigint").alias("ord"), no_id, F.col("id").alias("tie"), F.to_json(F.struct(*links.columns)).alias("front"), no_rest),
    ]
    items = stash(rows[0].unionAll(rows[1]).unionAll(rows[2]).withColumn("n", F.monotonically_increasing_id()), "items")
    order = ["section", "ord", F.concat_ws("|", F.when(F.col("id").isNotNull(), _uuid_text()), "tie")]
    totals = {r["section"]: r["count"] for r in items.groupBy("section").count().collect()}  # three rows
    first = [r["n"] for section in totals for r in items.filter(F.col("section") == section).orderBy(*order, "n").select("n").limit(1).collect()]
    heads = [
        (0, F.concat(F.lit('{"generated_at": '), F.to_json(F.lit(generated_at).cast("variant")), F.lit(f', "node_count": {totals.get(1, 0)}, "edge_count": {totals.get(3, 0)}, "nodes": ['))),
        (2, F.lit('], "edges": [')), (4, F.lit('], "soft_links": [')), (6, F.lit("]}")),
    ]
    frame = graph.spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("section"), text.alias("front")) for k, text in heads])).alias("x")).select(
        "x.section", F.lit(0).cast("bigint").alias("ord"), no_id, F.lit("").alias("tie"), "x.front", no_rest, F.lit("").alias("comma")
    )
    comma = F.when(F.col("n").isin(*first), "").otherwise(",") if first else F.lit(",")
    items = items.withColumn("comma", comma).drop("n").unionAll(frame)
    sorted_ = items.repartitionByRange(*order, "comma").sortWithinPartitions(*order, "comma")
    own = F.when(F.col("id").isNotNull(), F.concat(F.lit('"uuid":"'), _uuid_text(), F.lit('"'))).otherwise("")
    writer = sorted_.select(F.concat("comma", "front", own, "rest").alias("value")).write.mode("overwrite")
    with small_partitions(graph.spark):
        (writer.option("compression", compression) if compression else writer).text(folder)
