"""URN column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHAPE = r"(?s)^urn:([^:]*):([^:]*):([^:]*):([^:]*):(.*)$"
_FIELDS = ("provider", "service", "account", "region", "path")


def is_valid(urn: Column) -> Column:
    return urn.rlike(_SHAPE)


def part(urn: Column, field: str) -> Column:
    """One URN component; NULL for a malformed URN (F1)."""
    index = _FIELDS.index(field) + 1
    return F.when(is_valid(urn), F.regexp_extract(urn, _SHAPE, index))


def checked_part(urn: Column, field: str) -> Column:
    """Like :func:`part` but a malformed URN fails the query."""
    bad = F.raise_error(F.concat(F.lit("Invalid URN format: "), urn)).cast("string")
    return F.when(is_valid(urn), part(urn, field)).otherwise(bad)


def parent(urn: Column) -> Column:
    """Trim the last path segment; NULL when the path has none (F2)."""
    path = part(urn, "path")
    return F.when(path.contains("/"), F.regexp_replace(urn, r"(?s)/[^/]*$", ""))


def tail(urn: Column) -> Column:
    return F.substring_index(urn, "/", -1)


def short_label(urn: Column) -> Column:
    """Last three path segments after the last colon."""
    segments = F.split(F.substring_index(urn, ":", -1), "/")
    start = F.greatest(F.size(segments) - 2, F.lit(1))
    return F.array_join(F.slice(segments, start, F.lit(3)), "/")