"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import balanced, new_folder, shared_root, stored

__all__ = ["BATCH_ROWS", "cut", "few_rows", "hash_share", "new_folder", "released", "shared_root", "short_batches", "stored", "table", "text_hash"]

#: Rows that one Arrow batch carries to Python; texts may be long, so batches stay short.
BATCH_ROWS = 250


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage by a reliable checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def short_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch of whole texts takes of a Python worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextlib.contextmanager
def few_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """For what runs inside, Arrow batches of so many rows, as each of them is large; the session's own setting comes back after it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hash_share(rows: int, n: int, *of: Column) -> Column:
    """Whether a row belongs to the about `rows` of n that a hash of its columns chooses; the share is one of 2**62, so it never rounds to nothing."""
    return F.pmod(F.xxhash64(*of), F.lit(2**62)) < min(rows * 2**62 // max(n, 1), 2**62)


def text_hash() -> Column:
    """Tells rows that repeat a doc_id apart by their text."""
    return F.xxhash64(F.col("text").cast("string"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return balanced(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def released(rows: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that gives the memory it no longer needs back to the system when a task ends, as Python workers live on."""

    def run(batches: Iterator) -> Iterator:
        yield from rows(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run
