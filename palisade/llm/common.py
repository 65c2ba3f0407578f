"""What several of these operators share: tables, word patterns, lineage cuts and Arrow batches."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade import session
from palisade.session import shared_folder

__all__ = ["WORD_BREAK", "in_arrow", "public_vocabulary", "release", "shared_folder", "stash", "stash_at", "table", "unused", "words"]

#: White space between words: blank and U+0009 to U+000D, nothing else.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def stash_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As in ``session``, packed as the session says: most of these tables are hashes, and memory is measured closely."""
    return session.stash_at(df, label, None)


def stash(df: DataFrame, label: str) -> DataFrame:
    return stash_at(df, label)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def unused(columns: list[str], *names: str) -> list[str]:
    """Names like ``names`` that no column has, in whatever case."""
    taken = {c.lower() for c in columns}
    mark = ""
    while any(f"{mark}{name}".lower() in taken for name in names):
        mark += "_"
    return [f"{mark}{name}" for name in names]


def public_vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; it is installed on every executor, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def in_arrow(
    df: DataFrame, rows: Callable[[list[dict]], Iterator[dict]], schema: str, max_rows: int = 256
) -> DataFrame:
    """Map lists of at most ``max_rows`` rows to rows, one Arrow batch in memory at a time."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def batches(stream):
        for batch in stream:
            for start in range(0, batch.num_rows, max_rows):
                out = list(rows(batch.slice(start, max_rows).to_pylist()))
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(batches, schema)


def release(spark: SparkSession) -> None:
    """Let go of finished shuffles: Spark deletes their files once the driver has collected the frames that own them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
