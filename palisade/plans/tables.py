"""Reading the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


class Tables:
    """``Tables(spark, dir).orders`` is the ``orders`` table; nothing is read eagerly."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        frame = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, frame)  # one file listing and footer read per table
        return frame

    def state(self, *names: str) -> str:
        """Changes when files of the tables do; their content is not read."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{self.folder}/{n}.parquet" for n in names])
        marks = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
        return "{} {}".format(*files.agg(F.count("*"), F.sum(marks)).first())
