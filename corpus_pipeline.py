"""Corpus pipeline: toxic documents go, then repeated lines, then near copies; sources are mixed and texts encoded.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns the columns of documents; the last
returns the ids of the pieces of each text. Null and empty texts pass all stages: they are not toxic, hold no line and
copy nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import lines, minhash, mixing, pieces, toxicity
from lectern.llm.store import cut, small_batches, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold of the classifier, which learns from the labelled ones among docs."""
    small_batches(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; those that lose every line go."""
    small_batches(spark)
    return lines.drop_repeated_lines(docs)


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    small_batches(spark)
    return minhash.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as drawn for the mixture; one that is drawn twice is two rows."""
    return mixing.mixed_documents(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the pieces of each document."""
    small_batches(spark)
    return pieces.encode(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", minhash_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", sentencepiece_stage),
]

#: SQL can express neither the classifier nor the fuzzy stages; run() is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
