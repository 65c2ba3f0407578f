"""Session helpers: a tuned session for tests, and lineage cutting for loops."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
SMALL = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m", "spark.sql.files.maxPartitionBytes": "32m"}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; clusters bring their own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("palisade")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Where iterative jobs may write between rounds.

    The cluster names the folder in ``spark.checkpoint.dir``.  Only a local
    session, whose executors share the driver's disk, may fall back to a
    temporary folder; a cluster without the setting is refused.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="palisade-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/palisade/{spark.sparkContext.applicationId}"


@contextmanager
def small_partitions(spark: SparkSession) -> Iterator[None]:
    """What is written here keeps partitions of some 8 MB of shuffled rows apart, or 32 MB of files, unless the session names sizes.

    For rows that are sorted before they are written: in memory, and often wider than they were shuffled, those of
    Spark's usual 64 and 128 MB would be spilled.
    """
    unset = {key: size for key, size in SMALL.items() if spark.conf.get(key, None) is None}
    for key, size in unset.items():
        spark.conf.set(key, size)
    try:
        yield
    finally:
        for key in unset:
            spark.conf.unset(key)


def stash(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as a Parquet table in the shared folder and read it back.

    Unlike a checkpointed RDD the table is columnar, survives executor loss, and
    tells the planner its true size, so later joins against a small frontier are
    broadcast because the size was measured, not because a hint said so.
    """
    return stash_at(df, label)[0]


def stash_at(df: DataFrame, label: str, codec: str | None = "zstd") -> tuple[DataFrame, str]:
    """As ``stash``, with the path; without ``codec`` the session's."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stash_counted(df: DataFrame, label: str) -> tuple[DataFrame, str, int]:
    """As ``stash_at``, with the number of rows, which comes from the footers of the files."""
    frame, path = stash_at(df, label)
    return frame, path, frame.count()
