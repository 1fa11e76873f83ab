"""Tables in buckets of their key, of which a change rewrites only what it touches.

Rows lie below data/gen=G/bucket=B, a key's rows in one bucket. Which generation of each bucket counts, with what is known of it, is written last, to pointers/version=G; so readers see a change whole or not at all, a job that fails half-way leaves files nobody reads, and a bucket may become empty. One writer at a time. Pointers are a row for each bucket, a fixed number, and the only rows that come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import Files, stored

#: Of a bucket: its generation, the last change merged into it, and the fingerprint of what it was made of.
POINTER = "bucket int, gen long, upto long, n long, one decimal(38,0), two decimal(38,0)"


def bucket_of(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int").alias("bucket")


class Buckets:
    """A table of a schema below a path."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], n: int = 256):
        self.spark, self.path, self.keys, self.n = spark, path, keys, n
        self.schema = T.StructType.fromDDL(schema)

    def pointers(self) -> DataFrame:
        """The current row of each bucket."""
        folder = f"{self.path}/pointers"
        if not Files(self.spark).found(f"{folder}/*"):
            return self.spark.createDataFrame([], POINTER)
        every = self.spark.read.schema(f"{POINTER}, version long").parquet(folder)
        last = every.agg(F.max("version")).first()[0]
        return every.where(F.col("version") == F.lit(last)).drop("version")

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The rows, of some buckets or all; no file of another generation or bucket is opened."""
        live = [(r.gen, r.bucket) for r in self.pointers().collect() if only is None or r.bucket in only]
        if not live or not Files(self.spark).found(f"{self.path}/data/*"):
            return self.spark.createDataFrame([], self.schema)
        every = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("gen", T.LongType()), T.StructField("bucket", T.IntegerType())])).parquet(f"{self.path}/data")
        return every.where(F.concat_ws("/", "gen", "bucket").isin([f"{g}/{b}" for g, b in live])).select(self.schema.names)

    def replace(self, rows: DataFrame, changed: DataFrame) -> list[int]:
        """Puts rows in place of all buckets of changed(bucket, upto, n, one, two), which must be all that rows lie in; the buckets written."""
        old, new = self.pointers().collect(), changed.collect()
        gen = 1 + max((r.gen for r in old), default=0)
        gone = {r.bucket for r in new}
        if not gone:
            return []
        dealt = rows.select(*self.schema.names, bucket_of(self.keys, self.n)).repartition("bucket")
        dealt.write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/data/gen={gen}")
        kept = [tuple(r) for r in old if r.bucket not in gone] + [(r.bucket, gen, r.upto, r.n, r.one, r.two) for r in new]
        self.spark.createDataFrame(kept, POINTER).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/pointers/version={gen}")
        return sorted(gone)


# What changed in the data


def prints(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(bucket, n, one, two) of rows by the bucket of their key: rows and two sums of row hashes, exact, so of no order. Counted before it is shuffled."""
    names = sorted(rows.columns)
    hashed = lambda seed: F.sum(F.xxhash64(F.lit(seed), *names).cast("decimal(38,0)")).cast("decimal(38,0)")
    return rows.groupBy(bucket_of(keys, n)).agg(F.count("*").alias("n"), hashed(1).alias("one"), hashed(2).alias("two"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(bucket, upto, n, one, two) of the buckets that aren't as they were; n is 0 where no row is left, as in a bucket that never had one."""
    was = old.where("n > 0").select("bucket", F.struct("n", "one", "two").alias("was"))
    both = new.select("bucket", F.struct("n", "one", "two").alias("is")).join(was, "bucket", "full_outer")
    none = F.lit(0).cast("decimal(38,0)")
    return both.where(~F.col("is").eqNullSafe(F.col("was"))).select("bucket", F.lit(0).cast("long").alias("upto"), F.coalesce("is.n", F.lit(0)).alias("n"), F.coalesce("is.one", none).alias("one"), F.coalesce("is.two", none).alias("two"))


def refreshed(table: Buckets, rows: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[int]]:
    """compute(rows), kept in a table from run to run, and the buckets that were computed again: those whose rows have changed. compute must work on each key (the table's) by itself, and its rows must carry the key."""
    told = stored(changed(table.pointers(), prints(rows, table.keys, table.n)))
    again = [r.bucket for r in told.select("bucket").collect()]
    if not again:
        return table.read(), []
    some = rows.where(bucket_of(table.keys, table.n).isin(again))
    written = table.replace(compute(some), told)
    return table.read(), written


# Changes kept beside a table


class Deltas:
    """A table whose changes are kept beside it, are merged when it is read, and are worked into it by compact()."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], n: int = 256):
        self.base = Buckets(spark, f"{path}/base", schema, keys, n)
        self.spark, self.path, self.keys, self.n = spark, path, keys, n
        self.names = self.base.schema.names
        fields = [*self.base.schema.fields, T.StructField("deleted", T.BooleanType()), T.StructField("seq", T.LongType()), T.StructField("bucket", T.IntegerType())]
        self.kept = T.StructType(fields)

    def upsert(self, rows: DataFrame, seq: int) -> None:
        """rows in place of those of equal keys, from change number seq on, which must be new; of rows with one key the one that comes last by all columns counts."""
        self._put(rows.select(self.names), False, seq)

    def delete(self, keys: DataFrame, seq: int) -> None:
        """Removes the rows of some keys."""
        there = [F.col(c) if c in self.keys else F.lit(None).cast(self.base.schema[c].dataType).alias(c) for c in self.names]
        self._put(keys.select(there), True, seq)

    def _put(self, rows: DataFrame, deleted: bool, seq: int) -> None:
        made = rows.withColumns({"deleted": F.lit(deleted), "bucket": bucket_of(self.keys, self.n)})
        made.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/delta/seq={seq}")

    def deltas(self) -> DataFrame:
        """Changes that the base hasn't taken in, the last one of each key."""
        if not Files(self.spark).found(f"{self.path}/delta/*"):
            return self.spark.createDataFrame([], self.kept)
        upto = {r.bucket: r.upto for r in self.base.pointers().collect()}
        rows = self.spark.read.schema(self.kept).parquet(f"{self.path}/delta")
        least = min(upto.values(), default=0) if len(upto) == self.n else 0
        news = rows.where(F.col("seq") > least)
        if upto:
            known = F.create_map(*[F.lit(x) for pair in upto.items() for x in pair])
            news = news.where(F.col("seq") > F.coalesce(known[F.col("bucket")], F.lit(0)))
        others = [c for c in self.kept.names if c not in self.keys]
        last = news.groupBy(*self.keys).agg(F.max(F.struct("seq", *[c for c in others if c != "seq"])).alias("last"))
        return last.select(*self.keys, "last.*").select(self.kept.names)

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The table with its changes: base rows of keys that changed give way to the last change. Few changes are broadcast by Spark's own measure, so the base isn't shuffled for them."""
        news, base = self.deltas(), self.base.read(only)
        if only is not None:
            news = news.where(F.col("bucket").isin(only))
        return base.join(news.select(self.keys), self.keys, "left_anti").select(self.names).unionByName(news.where("not deleted").select(self.names))

    def compact(self) -> list[int]:
        """Works the changes into the base; only buckets that have any are written, and named."""
        touched = stored(self.deltas().groupBy("bucket").agg(F.max("seq").alias("upto")))
        some = [r.bucket for r in touched.select("bucket").collect()]
        if not some:
            return []
        none = F.lit(0).cast("decimal(38,0)")
        return self.base.replace(self.read(some), touched.select("bucket", "upto", F.lit(1).cast("long").alias("n"), none.alias("one"), none.alias("two")))
