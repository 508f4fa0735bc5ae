"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows and bytes of one Arrow batch: whole texts are handed to Python, so a batch must stay small whatever their length.
BATCH_ROWS, BATCH_BYTES = 512, 64 << 20
#: Rows of one batch of a few numbers each.
LONG_BATCH = 1 << 14


def shared_dir(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; where that is unset, a temporary one of this machine, in local mode only (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lectern-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: no lineage, and executors may be lost.

    A written table is preferred to checkpoint() here because the latter runs the last stage twice and
    stores uncompressed rows. The files stay until the owner of the shared folder clears it.
    """
    path = f"{shared_dir(df.sparkSession)}/lectern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless it has lower bounds already. A text beyond the bytes is a batch of its own."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


@contextmanager
def long_batches(spark: SparkSession) -> Iterator[None]:
    """Longer Arrow batches for what is run meanwhile: rows of a few numbers, of which small batches cost more than they hold."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(LONG_BATCH))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def set_bits(rows: DataFrame, column: str, size: int) -> np.ndarray:
    """A filter of `size` bits, packed lowest first, with the bits set at the places that a column of longs holds."""
    at = F.col(column) + 1
    maps = rows.select(F.bitmap_bucket_number(at).alias("k"), F.bitmap_bit_position(at).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for m in maps.toLocalIterator():  # `size` bits reach the driver at most, however many rows there are
        part = np.frombuffer(bytes(m["bits"]), np.uint8)
        bits[(m["k"] - 1) * len(part) : m["k"] * len(part)] = part
    return bits
