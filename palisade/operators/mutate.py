"""Metadata updates and deletions from a mutation log (M1, M2)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions import meta
from palisade.model import NODE_KEYS


class BadPatchError(ValueError):
    """The patch text is not a JSON object."""


def check_patch(text: str) -> dict:
    """Driver-side check of one user-supplied patch."""
    try:
        patch = json.loads(text)
    except (TypeError, json.JSONDecodeError) as exc:
        raise BadPatchError(f"invalid JSON metadata: {exc}") from exc
    if not isinstance(patch, dict):
        raise BadPatchError("metadata must be a JSON object")
    return patch


def _typed(text: Column, kind: str) -> Column:
    """JSON text of one value as the key's type."""
    if kind == "string":
        return F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")
    if kind == "variant":
        return F.try_parse_json(text)
    return F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), f"v {kind}")["v"]


def merged_patches(log: DataFrame) -> DataFrame:
    """``(urn, patch map<key, JSON text>)``: the last write per node *and key* wins.

    ``log`` has ``urn, seq, patch`` (a JSON object); JSON ``null`` deletes the key.
    Keys are exploded and reduced before they are gathered, so a node with a very
    long history contributes one row per key, not its history.
    """
    entries = log.select("urn", "seq", F.explode(F.from_json("patch", "map<string,variant>")).alias("key", "value"))
    last = entries.select("urn", "key", "seq", F.to_json("value").alias("value")).groupBy("urn", "key").agg(
        F.max_by("value", "seq").alias("value")
    )
    return last.groupBy("urn").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("patch"))


def apply_patches(nodes: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """Shallow-merge patches into metadata.

    ``keys`` are the keys that may occur (they extend the struct); vocabulary keys
    become typed fields and any other key goes to ``extra``.
    """
    own = meta.keys_of(nodes)
    typed = own + [k for k in keys if k in NODE_KEYS and k not in own]
    joined = nodes.join(patches, "urn", "left")
    patch = F.col("patch")
    fields = []
    for k in typed:
        old = meta.get(nodes, k) if k in own else None
        kind = meta.key_type(nodes, k).simpleString() if k in own else NODE_KEYS[k]
        text = patch[k]
        new = _typed(text, kind)
        value = F.when(text == "null", F.lit(None)).when(text.isNotNull(), new)
        kept = value if old is None else value.otherwise(old)
        fields.append(kept.alias(k))
    out = joined.withColumn("metadata", F.struct(*fields))
    loose = [k for k in keys if k not in typed]
    if loose or "extra" in nodes.columns:
        old = F.col("extra") if "extra" in nodes.columns else F.create_map().cast("map<string,string>")
        old = F.coalesce(old, F.create_map().cast("map<string,string>"))
        fresh = F.coalesce(F.map_filter(patch, lambda k, v: ~k.isin(*typed)), F.create_map().cast("map<string,string>"))
        kept = F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key(fresh, k), F.lit(False)))
        live = F.map_filter(F.map_concat(kept, fresh), lambda k, v: v != "null")
        out = out.withColumn("extra", F.when(F.size(live) > 0, live))
    return out.drop("patch").select(*nodes.columns, *(["extra"] if "extra" in out.columns and "extra" not in nodes.columns else []))


def update_node_metadata(nodes: DataFrame, urn: str, patch: str) -> DataFrame:
    """M1 for one node: merge a JSON object into its metadata."""
    fields = check_patch(patch)
    hit = F.col("urn") == urn
    text = {k: json.dumps(v) for k, v in fields.items()}
    one = F.create_map(*[F.lit(x) for kv in text.items() for x in kv]) if text else F.lit(None).cast("map<string,string>")
    spark = nodes.sparkSession
    patches = spark.range(1).select(F.lit(urn).alias("urn"), one.cast("map<string,string>").alias("patch"))
    if nodes.filter(hit).isEmpty():
        raise KeyError(f"node not found in graph: {urn}")
    return apply_patches(nodes, patches, list(fields))


def delete_node_metadata(nodes: DataFrame, urn: str, *keys: str) -> DataFrame:
    """M2 for one node: drop keys; absent ones are ignored."""
    hit = F.col("urn") == urn
    own = [k for k in keys if k in meta.keys_of(nodes)]
    out = nodes
    if own:
        metadata = F.col("metadata")
        for k in own:
            kind = meta.key_type(nodes, k)
            none = F.parse_json(F.lit(None).cast("string")) if isinstance(kind, T.VariantType) else F.lit(None).cast(kind)
            metadata = metadata.withField(k, F.when(~hit, F.col("metadata")[k]).otherwise(none))
        out = out.withColumn("metadata", metadata)
    if "extra" in nodes.columns:
        out = out.withColumn("extra", F.when(hit, F.map_filter("extra", lambda k, v: ~k.isin(*keys))).otherwise(F.col("extra")))
    return out
