"""Deterministic identifiers (F3): UUIDv5 as a pure Spark expression."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.model import EDGE_ID_SUFFIX

# --- fixed values: UUID namespaces ids are derived in -------------------------
EDGE_NAMESPACE = "039c74f2ed315158a5ff5ab3a6944067"
CANDIDATE_NAMESPACE = "11b3779d5ba853a79143182651da22f8"
# Our own namespace for user-made links, so removing one can never remove a
# scanned edge between the same two nodes.
SOFT_LINK_NAMESPACE = "6f0d6c2c6a0e5b6f9d6a1c7e2f4b8a90"

_VARIANT_DIGITS = "89ab" * 4


def uuid5_sql(namespace: str, name: str) -> str:
    """RFC 4122 version-5 UUID text of the SQL expression ``name``.

    ``namespace`` is 32 hex digits.  Spelled as one SQL text because a graph has
    many edge frames and each needs the expression.
    """
    digest = f"sha1(concat(unhex('{namespace}'), encode({name}, 'UTF-8')))"
    variant = f"translate(substr({digest}, 17, 1), '0123456789abcdef', '{_VARIANT_DIGITS}')"
    return (
        f"concat(substr({digest}, 1, 8), '-', substr({digest}, 9, 4), '-5', substr({digest}, 14, 3), "
        f"'-', {variant}, substr({digest}, 18, 3), '-', substr({digest}, 21, 12))"
    )


def uuid5(namespace: str, name: Column) -> Column:
    """Column form of :func:`uuid5_sql`."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", _VARIANT_DIGITS)
    piece = lambda start, n: F.substring(digest, start, n)
    return F.concat(
        F.concat_ws("-", piece(1, 8), piece(9, 4), F.concat(F.lit("5"), piece(14, 3))),
        F.lit("-"), variant, piece(18, 3), F.lit("-"), piece(21, 12),
    )


def edge_id_sql(src: str, dst: str, edge_type: str) -> str:
    suffix = EDGE_ID_SUFFIX.get(edge_type, edge_type)
    return uuid5_sql(EDGE_NAMESPACE, f"concat({src}, ':', {dst}, ':{suffix}')")


def edge_suffix(edge_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(EDGE_ID_SUFFIX.items())])
    return F.coalesce(table[edge_type], edge_type)


def edge_id(src: Column, dst: Column, edge_type: Column | str, account: Column | None = None) -> Column:
    """Edge UUID; ``sso:assigned_to`` also folds the account in."""
    if isinstance(edge_type, str):
        suffix = F.lit(EDGE_ID_SUFFIX.get(edge_type, edge_type))
    else:
        suffix = edge_suffix(edge_type)
    pieces = [src, F.lit(":"), dst, F.lit(":")]
    if account is not None:
        pieces += [account, F.lit(":")]
    return uuid5(EDGE_NAMESPACE, F.concat(*pieces, suffix))


def soft_link_edge_id(src: Column, dst: Column, edge_type: Column, compat: bool = False) -> Column:
    """Id of a soft link's edge; ``compat`` shares the scanned edges' namespace."""
    name = F.concat(src, F.lit(":"), dst, F.lit(":"), edge_type)
    return uuid5(EDGE_NAMESPACE if compat else SOFT_LINK_NAMESPACE, name)


def candidate_id(source: Column, heuristic: Column | str, dest: Column | None = None) -> Column:
    heuristic = F.lit(heuristic) if isinstance(heuristic, str) else heuristic
    middle = F.lit("") if dest is None else F.coalesce(F.concat(dest, F.lit(":")), F.lit(""))
    return uuid5(CANDIDATE_NAMESPACE, F.concat(source, F.lit(":"), middle, heuristic))
