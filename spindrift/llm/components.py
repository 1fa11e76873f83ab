"""Connected components of links between integers, by alternating large and small stars.

No link, label or component goes to the driver, only counts. The minima of neighbours are pre-aggregated before they are shuffled; links and minima are joined from stored tables, so that Spark splits the links of a hub.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LINKS = "a long, b long"


class Forest:
    """Union-find whose roots are the least members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def link(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def stars(self) -> tuple[list[int], list[int]]:
        """Each member but the roots, and its root."""
        members = [x for x, y in self.up.items() if x != y]
        return members, [self.root(x) for x in members]


def local_stars(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Replaces the links of a task, at most so many members at a time, by stars that join the same members."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.link(a, b)
        if len(forest.up) >= most:
            yield _rows(forest)
            forest = Forest()
    yield _rows(forest)


def _rows(forest: Forest) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in forest.stars()], ["a", "b"])


def label(links: DataFrame) -> DataFrame:
    """links(a, b): any links. Returns (a, b): every linked integer but the least of its component, and that least one."""
    links = common.stored(links.where("a <> b").mapInArrow(local_stars, LINKS))
    while not _stars(links):
        both = common.stored(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = common.stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
        larger = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = common.stored(larger.where("a <> b").distinct())
        least = common.stored(links.groupBy("a").agg(F.min("b").alias("m")))
        smaller = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = common.stored(smaller.unionAll(least.select("a", F.col("m").alias("b"))).distinct())
    return links


def _stars(links: DataFrame) -> bool:
    """Whether every member points to one root and no root points on."""
    if links.groupBy("a").count().where("count > 1").limit(1).count():
        return False
    return not links.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
