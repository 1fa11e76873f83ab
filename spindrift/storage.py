"""The folder that driver and executors share, and files there through Hadoop's file systems."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, one of our own, which only a local master can share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = f"file:///tmp/checkpoints/{os.getpid()}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Computes df once into a Parquet table in the shared folder and reads it back; unlike a checkpoint the table has no partitioning left, so Spark may split a hot key in a later join."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one partition may hold whatever its share.
FEW_ROWS = 500


def balanced(scan: DataFrame) -> DataFrame:
    """A scanned table, dealt out anew if one partition holds over twice its fair share of the rows, as the single row group of a small file does; a count of rows by partition, which reads no column, tells."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    sizes = scan.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("total")).first()
    if (sizes.most or 0) > FEW_ROWS and sizes.most * cores > 2 * sizes.total:
        return scan.repartition(4 * cores)
    return scan


#: Bytes that one Arrow batch carries to Python.
BATCH_BYTES = 2 << 20


def short_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch of whole texts takes of a Python worker's memory, by its bytes, so that short rows stay many to a batch. It holds for the session, as a lazy plan takes it when it runs; a smaller bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


class Files:
    """Small files of any store that Spark reaches."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _open(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def exists(self, path: str) -> bool:
        store, at = self._open(path)
        return store.exists(at)

    def found(self, pattern: str) -> bool:
        """Whether anything matches a pattern."""
        store, at = self._open(pattern)
        return bool(store.globStatus(at))

    def text(self, path: str) -> str:
        store, at = self._open(path)
        stream = store.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str, anew: bool = False) -> None:
        """Writes a file whole, replacing an older one; with `anew` an older one is an error, and of several writers one succeeds."""
        store, at = self._open(path)
        if not anew:
            part = self._open(f"{path}.part")[1]
            self._put(store.create(part, True), text)
            if store.exists(at):
                store.delete(at, False)
            if not store.rename(part, at):
                raise OSError(f"{path} can't be replaced")
            return
        try:
            stream = store.create(at, False)
        except Exception as e:
            if store.exists(at):
                raise FileExistsError(path) from e
            raise
        self._put(stream, text)

    def _put(self, stream, text: str) -> None:
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def age(self, path: str) -> float:
        """Seconds since a file was written, by this driver's clock."""
        import time

        store, at = self._open(path)
        return time.time() - store.getFileStatus(at).getModificationTime() / 1000

    def delete(self, path: str) -> None:
        store, at = self._open(path)
        store.delete(at, False)
