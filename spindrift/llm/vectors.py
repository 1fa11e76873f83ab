"""What the two vector searches share: every query meets every candidate in bounded blocks, and the best are merged.

Candidates are dealt into shards, and queries into blocks, of a fixed size by a hash; a block goes to every shard and a shard to every block (a stated query set against all rows). Both are cogrouped by shard and block, so a task holds one of each at a time. The first shard goes ahead, so that all others start from the scores it found.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARD = 4096
QUERIES = 2048
FOUND = "query_id long, vec_id long, score {kind}"


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """(vec_id, v): vectors without a null, without a null or non-finite component, and, unless zero is true, not all zero; v holds doubles."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    found = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    return found if zero else found.where(F.exists("v", lambda x: x != 0))


def matrix(t: pa.Table, name: str = "v") -> np.ndarray:
    flat = t.column(name).combine_chunks()
    values = flat.values if isinstance(flat, pa.ListArray) else flat.flatten()
    return values.to_numpy(zero_copy_only=False)[flat.offsets[0].as_py() : flat.offsets[-1].as_py()].reshape(len(flat), -1)


def search(found: DataFrame, is_query: Column, k: int, kind: str, best: Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]], largest: bool, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """found(vec_id, v) -> (query_id, rank, vec_id, score), the k best of each query.

    best(ids, vectors, query ids, query vectors, bars) returns the k best of a shard for each query: query ids, vec_ids and scores; a query is no candidate of its own. bars are scores that the k best of all are known to reach (nan: none known); what is worse may be left out. The first shard is searched without bars; its k-th best scores are the bars of all other shards.
    Vectors of unlike sizes meet only their like. Of repeated query rows the least vector asks. Equal rows are counted before they are dealt out, and of more than k of them k are candidates, as more can't be among k best; so no shard holds many of them.
    """
    counted = common.stored(found.groupBy("vec_id", "v").agg(F.count("*").alias("copies")))
    found = counted.select("vec_id", "v", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))).alias("copy")).select("vec_id", "v", F.size("v").alias("size"))
    n = found.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    shards, blocks = max(1, math.ceil(n.n / shard)), max(1, math.ceil(n.q / block))
    names = ["query_id", "vec_id", "score"]
    number = pa.int64() if kind == "long" else pa.float64()
    rows = found.select("vec_id", "v", "size", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).alias("shard"))  # unlike rows of one vec_id are spread
    queries = found.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("size", F.size("v")).select("vec_id", "v", "size", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            made = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        else:
            made = best(left.column("vec_id").to_numpy(), matrix(left), right.column("vec_id").to_numpy(), matrix(right), right.column("bar").to_numpy().astype(float))
        return pa.table([pa.array(x, t) for x, t in zip(made, (pa.int64(), pa.int64(), number), strict=True)], names)

    def meet(rows: DataFrame, queries: DataFrame, first: int, last: int) -> DataFrame:
        key = ["size", "shard", "block"]
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        queries = queries.select("*", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))).alias("shard"))
        queries = queries.toDF(*queries.columns)  # names of its own, as both sides come from one table
        return rows.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(pair, FOUND.format(kind=kind))

    none = F.lit(None).cast("double").alias("bar")
    near = meet(rows.where("shard = 0"), queries.select("*", none), 0, 0)
    if shards > 1:
        near = common.stored(near)
        bars = near.groupBy("query_id").agg(F.count("*").alias("n"), (F.min if largest else F.max)("score").cast("double").alias("bar")).where(F.col("n") >= k)
        barred = queries.join(bars.select(F.col("query_id").alias("vec_id"), "bar"), "vec_id", "left")
        near = near.unionByName(meet(rows.where("shard > 0"), barred, 1, shards - 1))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc() if largest else F.col("score").asc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top(ids: np.ndarray, scores: np.ndarray, k: int, largest: bool) -> np.ndarray:
    """Places of the k best scores, ties to smaller ids."""
    if len(scores) > 8 * k:
        signed = -scores if largest else scores
        edge = np.partition(signed, k - 1)[k - 1]
        some = np.nonzero(signed <= edge)[0]
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some] if largest else scores[some]))[:k]]
