"""Building canonical node and edge frames from rows, with fields given as SQL text.

SQL text keeps plan building cheap: a loader makes dozens of frames, and one
``selectExpr`` per frame costs one call into the JVM instead of one per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from palisade.functions import ids
from palisade.model import DEFAULT_ORG, EDGE_KEYS, NODE_KEYS


def _struct(fields: dict[str, str], vocabulary: dict[str, str]) -> str:
    packed = ", ".join(f"cast({sql} as {vocabulary.get(k, 'string')}) as {k}" for k, sql in fields.items())
    return f"struct({packed}) as metadata"


def node_frame(df: DataFrame, kind: str, urn: str, parent: str | None, ordinal: str, **fields: str) -> DataFrame:
    return df.selectExpr(
        f"{urn} as urn",
        f"'{DEFAULT_ORG}' as organization_id",
        f"{parent or 'cast(null as string)'} as parent_urn",
        f"'{kind}' as node_type",
        _struct(fields, NODE_KEYS),
        f"cast({ordinal} as bigint) as ord",
    )


def edge_frame(
    df: DataFrame, kind: str, src: str, dst: str, ordinal: str, account: str | None = None, **fields: str
) -> DataFrame:
    """Edges with their deterministic id; ``account`` enters the id where the type asks for it."""
    fields = fields or {"detection_method": "null"}
    more = [f"{account} as _account"] if account else []
    ends = df.selectExpr(
        f"{src} as from_urn", f"{dst} as to_urn", f"cast({ordinal} as bigint) as ord", _struct(fields, EDGE_KEYS), *more
    )
    middle = "concat(to_urn, ':', _account)" if account else "to_urn"
    return ends.selectExpr(
        f"{ids.edge_id_sql('from_urn', middle, kind)} as uuid",
        f"'{DEFAULT_ORG}' as organization_id",
        "from_urn",
        "to_urn",
        f"'{kind}' as edge_type",
        "metadata",
        "ord",
    )


def stable_ordinal(*columns: str) -> str:
    """A deterministic ordinal for rows whose source states no order."""
    return f"(xxhash64({', '.join(columns)}) & 281474976710655L)"
