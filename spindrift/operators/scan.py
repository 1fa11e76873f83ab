"""Running sums of keys of any size.

A window holds all rows of a key in one task. Where a key has more than `most` rows, the scan takes two levels instead: rows are dealt by ranges of (key, order), so a key lies in as many tasks as its share of the rows asks for; each range sums its part of a key, the parts' totals (as many for a key as there are ranges) are summed before one another, and each row adds what its part starts from. Sums are of integers or exact decimals, so the split doesn't show in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: Rows of a key that one task may sum.
HOT = 1_000_000


def exact(x: Column) -> Column:
    """A double as a decimal of 12 places, of which any order of summing gives the same sum."""
    return x.cast("decimal(38,12)")


def hot(rows: DataFrame, key: list[str], most: int) -> bool:
    """Whether a key has more than `most` rows; only the key is read and rows are counted before they are shuffled."""
    return bool(rows.groupBy(*key).count().where(F.col("count") > most).limit(1).count())


def running(rows: DataFrame, key: list[str], order: list[Column], sums: dict[str, Column], most: int = HOT) -> DataFrame:
    """rows with the sum of each column of `sums` over the rows of its key up to and with this one; nulls count as nothing, null keys are a key. order should tell a key's rows apart."""
    named = rows.withColumns({n: F.coalesce(c, F.lit(0)) for n, c in sums.items()} | {"_key": F.struct(*key)})
    if not hot(rows, key, most):
        w = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return named.withColumns({n: F.sum(n).over(w) for n in sums}).drop("_key")
    dealt = stored(named.repartitionByRange("_key", *order).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy("_key", "_part").agg(*[F.sum(n).alias(n) for n in sums])
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_key", "_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    own = Window.partitionBy("_key", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns({n: F.sum(n).over(own) for n in sums})
    return local.join(starts, ["_key", "_part"]).withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).select(*rows.columns, *sums)
