"""Access to the ``metadata`` struct: presence, truthiness and text rendering.

Presence (key not NULL) and truthiness (also non-empty, non-zero, not false) are
different questions and both are asked by the operators; keep them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.model import EDGE_KEYS, NODE_KEYS


def keys_of(df: DataFrame) -> list[str]:
    """Metadata keys the frame's struct carries."""
    field = next((f for f in df.schema.fields if f.name == "metadata"), None)
    if field is None or not isinstance(field.dataType, T.StructType):
        return []
    return field.dataType.fieldNames()


def key_type(df: DataFrame, name: str) -> T.DataType:
    for field in df.schema["metadata"].dataType.fields:
        if field.name == name:
            return field.dataType
    return T.StringType()


def get(df: DataFrame, name: str) -> Column:
    """Value of a metadata key, NULL when absent; unknown keys come from ``extra``."""
    if name in keys_of(df):
        return F.col("metadata")[name]
    if "extra" in df.columns:
        return F.get_json_object(F.concat(F.lit('{"v":'), F.col("extra")[name], F.lit("}")), "$.v")
    declared = NODE_KEYS.get(name) or EDGE_KEYS.get(name) or "string"
    return F.lit(None).cast(declared) if declared != "variant" else F.parse_json(F.lit(None).cast("string"))


def present(df: DataFrame, name: str) -> Column:
    if name not in keys_of(df) and "extra" in df.columns:
        return F.col("extra")[name].isNotNull()
    return get(df, name).isNotNull()


def truthy(df: DataFrame, name: str) -> Column:
    value = get(df, name)
    kind = key_type(df, name) if name in keys_of(df) else T.StringType()
    if isinstance(kind, T.BooleanType):
        hit = value
    elif isinstance(kind, T.NumericType):
        hit = value != 0
    elif isinstance(kind, T.ArrayType):
        hit = F.size(value) > 0
    elif isinstance(kind, T.StringType):
        hit = value != ""
    else:
        hit = value.isNotNull()
    return F.coalesce(hit, F.lit(False))


def text(df: DataFrame, name: str) -> Column:
    """Value as text for substring search: True/False for flags, JSON for nested values."""
    value = get(df, name)
    kind = key_type(df, name) if name in keys_of(df) else T.StringType()
    if isinstance(kind, T.BooleanType):
        return F.initcap(value.cast("string"))
    if isinstance(kind, (T.ArrayType, T.StructType, T.VariantType)):
        return F.to_json(value)
    return value.cast("string")


def pack(**fields: Column | str | int | float | bool | None) -> Column:
    """Build a metadata struct; plain values become literals."""
    cols = []
    for name, value in fields.items():
        col = value if isinstance(value, Column) else F.lit(value)
        declared = NODE_KEYS.get(name) or EDGE_KEYS.get(name) or "string"
        if declared not in ("variant",) and not declared.startswith("array<struct"):
            col = col.cast(declared)
        cols.append(col.alias(name))
    return F.struct(*cols)


def unknown_keys(df: DataFrame) -> list[str]:
    """D10 helper: struct keys outside the vocabulary (never enforced)."""
    return sorted(set(keys_of(df)) - set(NODE_KEYS) - set(EDGE_KEYS))
