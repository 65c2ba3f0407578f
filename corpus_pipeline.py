"""From raw documents to mixed, tokenised training text: stages of a corpus pipeline.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame; its result is written and
reread as the next one's ``docs``.  All but the last return the columns of ``docs``, whatever their names.

Defined cases: a null text is scored like an empty one, has no lines, joins no group and is not taken by
the mix, which leaves out all texts without words.  Repeated rows are scored and cut alike, the join keeps one
of them, and the mix may repeat it.  A null ``doc_id`` is kept or dropped by its text.  Texts of any length
pass whole.  Without labels nothing is learned; an empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palisade.llm import bpe, line_dedup, mixing, ngram_join, quality_cnn
from palisade.llm.common import stash, table


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network, trained on the labelled ones, does not reject."""
    return quality_cnn.accept(docs, quality_cnn.train(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that repeat an earlier one but for one edit."""
    return line_dedup.apply(docs)


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, similarity 0.8 or more."""
    return ngram_join.keep_one(docs, n=5, threshold=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a repeated document is a repeated row."""
    return mixing.mix(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of every text, and the digest of what they decode to."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality classifier", classify_quality),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", join_ngrams),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_bytes),
]

#: Training, hashing by bytes and tokenising have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stash(docs, f"stage{number}")
    return docs
