"""Foreign-key closures for access and deletion requests.

The generated statements of a SQL driver become lazily composed semi- and
anti-joins: every step is a DataFrame, a chain of any depth is one plan, and
single and composite keys are written the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_sentinel(table: DataFrame, columns: list[str], value: object) -> DataFrame:
    """M6: rows of the root table whose sentinel columns all equal the value."""
    rows = table
    for c in columns:
        rows = rows.filter(F.col(c) == F.lit(value))
    return rows


def follow_key(child: DataFrame, parent_rows: DataFrame, fk: list[str], target: list[str]) -> DataFrame:
    """M7: child rows whose foreign key points into the selected parent rows."""
    keys = parent_rows.select(*[F.col(t).alias(f) for f, t in zip(fk, target, strict=True)])
    return child.join(keys, fk, "left_semi")


def select_by_key(table: DataFrame, rows: DataFrame, pk: list[str]) -> DataFrame:
    """M8: all columns of the rows whose primary key was selected."""
    return table.join(rows.select(*pk), pk, "left_semi")


def survivors(table: DataFrame, rows: DataFrame, pk: list[str]) -> DataFrame:
    """M9: the table after deleting the selected keys (Parquet has no DELETE).

    A NULL key never equals anything, so such rows survive, as they do in SQL.
    """
    return table.join(rows.select(*pk), pk, "left_anti")


def outcome(rows: DataFrame) -> DataFrame:
    """Number of rows a request selects or affects."""
    return rows.agg(F.count("*").alias("rows_affected"))
