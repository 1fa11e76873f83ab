"""Approximate nearest neighbours by a vantage-point tree per shard.

A node holds a vantage point and, for the half of its points nearer to it and for the farther half, the least and largest distance to it. By the triangle inequality a query at distance d from the vantage point is at least d - largest, or least - d, from any point of a half; a half is skipped if that bound times `factor` exceeds the query's limit: its k-th best distance so far, or what another shard has already found if that is less. Factor one is exact, equal distances included; larger ones skip more and may miss. All queries of a block go down together, each half visited by those that are nearer to it first. In a leaf, distances by norms and a product, which round, only say which points may be within the limit; their distances are computed from the differences.

Every row is in the tree of its shard. Defined results: vectors that are null, all zero or hold null or non-finite components take no part, nor do rows without vec_id; repeated rows with a query's vec_id are not its candidates, other repeated rows are candidates each; vectors of unlike sizes don't meet; an empty table gives no rows; columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors

LEAF = 64
#: Share of the magnitudes by which a bound or a rounded distance may be wrong.
SLACK = 1e-11
#: Numbers in the differences that are held at once.
HELD = 4_000_000


@dataclass
class Node:
    rows: np.ndarray | None = None  # of a leaf
    point: int = -1
    halves: tuple[tuple[Node, float, float], ...] = ()


def build(x: np.ndarray, leaf: int = LEAF, rows: np.ndarray | None = None) -> Node:
    rows = np.arange(len(x)) if rows is None else rows
    if len(rows) <= leaf:
        return Node(rows)
    point = rows[np.argmax(((x[rows] - x[rows[0]]) ** 2).sum(axis=1))]  # far out, so that distances to it spread
    far = np.sqrt(((x[rows] - x[point]) ** 2).sum(axis=1))
    order = np.argsort(far, kind="stable")
    parts = np.split(order, [len(rows) // 2])
    return Node(None, int(point), tuple((build(x, leaf, rows[p]), float(far[p].min()), float(far[p].max())) for p in parts))


class Search:
    """The k best of a shard for a block of queries; ids ascend. Points beyond a query's bar (nan: no bar) may be left out."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float, bars: np.ndarray | None = None):
        self.ids, self.x, self.query_ids, self.queries, self.factor, self.k = ids, x, query_ids, queries, factor, k
        self.norms, self.query_norms = (x**2).sum(axis=1), (queries**2).sum(axis=1)
        self.far, self.at = np.full((len(queries), k), np.inf), np.full((len(queries), k), len(ids))
        self.limit = np.full(len(queries), np.inf) if bars is None else np.where(np.isnan(bars), np.inf, bars)

    def visit(self, node: Node, some: np.ndarray) -> None:
        if not len(some):
            return
        if node.rows is not None:
            return self.compare(node.rows, some)
        d = np.sqrt(((self.queries[some] - self.x[node.point]) ** 2).sum(axis=1))
        bounds = [self.factor * (np.maximum(d - most, least - d) - SLACK * (d + most)) for _, least, most in node.halves]
        nearer = d > (node.halves[0][2] + node.halves[1][1]) / 2  # which half each query is in
        for turn in (0, 1):
            for half in (0, 1):
                mine = (nearer == half) if turn == 0 else (nearer != half)
                self.visit(node.halves[half][0], some[mine & (bounds[half] <= self.limit[some])])

    def compare(self, rows: np.ndarray, some: np.ndarray) -> None:
        size = self.query_norms[some, None] + self.norms[rows]
        rough = size - 2 * self.queries[some] @ self.x[rows].T
        within = (rough - SLACK * size <= self.limit[some, None] ** 2) & (self.query_ids[some, None] != self.ids[rows])
        i, j = np.nonzero(within)
        far = np.full(within.shape, np.inf)
        step = max(1, HELD // self.x.shape[1])
        for lo in range(0, len(i), step):
            a, b = i[lo : lo + step], j[lo : lo + step]
            far[a, b] = np.sqrt(((self.x[rows[b]] - self.queries[some[a]]) ** 2).sum(axis=1))
        far[far > self.limit[some, None]] = np.inf
        far, at = np.hstack([self.far[some], far]), np.hstack([self.at[some], np.broadcast_to(rows, within.shape)])
        best = np.lexsort((at, far), axis=1)[:, : self.k]  # places are in the order of ids
        self.far[some], self.at[some] = np.take_along_axis(far, best, 1), np.take_along_axis(at, best, 1)
        self.limit[some] = np.minimum(self.limit[some], self.far[some, -1])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = np.nonzero(np.isfinite(self.far))
        return self.query_ids[i], self.ids[self.at[i, j]], self.far[i, j]


def nearest(table: DataFrame, is_query: F.Column, k: int = 10, factor: float = 1.25, leaf: int = LEAF, shard: int = vectors.SHARD, block: int = vectors.QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors found at the least Euclidean distance from each query row."""

    def best(ids, x, query_ids, queries, bars):
        order = np.argsort(ids, kind="stable")
        found = Search(ids[order], x[order], query_ids, queries, k, factor, bars)
        found.visit(build(found.x, leaf), np.arange(len(queries)))
        return found.result()

    return vectors.search(vectors.usable(table, zero=False), is_query, k, "double", best, largest=False, shard=shard, block=block)
