"""Exact top-k inner products of integer vectors by MaxScore.

A component makes two terms, one for each sign; a vector stands in the postings of a term with the size of its component (the two lists of a component are kept as one, by sign). A query's terms that agree with it in sign add to a score, by no more than its own component times the largest in the term's postings; terms of the other sign only take away. A shard is gone through in runs of vectors in ascending id. In each run a query's terms are sorted by that bound; the non-essential ones are the last, whose bounds together don't reach the bar: the k-th best score so far, or what another shard has already found if that is more. A vector that stands in no essential posting can't reach it. The essential postings are traversed, with those of the other sign of the same components; the other terms are probed, largest bound first, for those vectors whose score so far plus what bounds are left still competes. After each run the bar rises, and with it the border between essential and other terms; a run whose bounds together don't reach the bar is skipped. Scores that tie with the bar are kept, so ties go to the smaller id exactly.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without vec_id; repeated rows with a query's vec_id are not its candidates, other repeated rows are candidates each; vectors of unlike sizes don't meet; an empty table gives no rows; columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors

#: Vectors of a shard between two rises of the bar.
RUN = 2048
#: Non-essential terms probed between two looks at what still competes.
PROBES = 4


class Postings:
    """For each component and run: the rows (ascending, counted from the run's start) that have it, with their weights, whose sign says which of the component's two terms they are of. Lists that hold half of a run's rows or more are stacked, with weight 0 in their gaps, so that a product with a query's components traverses them together."""

    def __init__(self, x: np.ndarray, run: int):
        self.n, self.starts = len(x), list(range(0, len(x), run))
        self.size = [min(run, len(x) - s) for s in self.starts]
        self.multiplied = 0  # entries of lists that were traversed
        self.lists: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []  # by run: the shorter ones, by component
        self.full: list[tuple[np.ndarray, np.ndarray]] = []  # by run: components of the longer lists, and their weights, a row each
        self.largest: list[int] = []
        self.most = np.zeros((2, x.shape[1], len(self.starts)), np.int64)  # largest weight of each term (plus, minus) in each run
        for k, start in enumerate(self.starts):
            part = np.ascontiguousarray(x[start : start + run].T)
            self.most[0, :, k], self.most[1, :, k] = np.maximum(0, part.max(axis=1)), np.maximum(0, -part.min(axis=1))
            there = part != 0
            whole = 2 * there.sum(axis=1) >= part.shape[1]
            self.full.append((np.nonzero(whole)[0], part[whole].astype(np.float64)))
            self.largest.append(int(np.abs(part).max(initial=0)))
            self.lists.append({int(d): (np.nonzero(there[d])[0], part[d, there[d]]) for d in np.nonzero(~whole)[0]})

    def traverse(self, k: int, q: np.ndarray) -> np.ndarray:
        """Scores of a run's rows from the lists of the components that q (0 elsewhere) has."""
        dims, weights = self.full[k]
        use = np.nonzero(q[dims])[0]
        if len(use) < len(dims):  # the lists of other components stay untouched
            dims, weights = dims[use], weights[use]
        self.multiplied += weights.size
        if int(np.abs(q).sum()) * self.largest[k] < 2**53:  # whole numbers below it, and their sums, are exact
            scores = (q[dims].astype(np.float64) @ weights).astype(np.int64)
        else:
            scores = q[dims] @ weights.astype(np.int64)
        for d in np.nonzero(q)[0].tolist():
            if d in self.lists[k]:
                rows, values = self.lists[k][d]
                scores[rows] += q[d] * values
                self.multiplied += len(rows)
        return scores

    def probe(self, d: int, k: int, some: np.ndarray) -> np.ndarray:
        """The signed weights of some rows (ascending) of a run, 0 where they have no term of the component."""
        if d not in self.lists[k]:
            dims, weights = self.full[k]
            return weights[np.searchsorted(dims, d), some].astype(np.int64)
        rows, weights = self.lists[k][d]
        if not len(rows):
            return np.zeros(len(some), np.int64)
        at = np.minimum(np.searchsorted(rows, some), len(rows) - 1)
        return np.where(rows[at] == some, weights[at], 0)


def scored(postings: Postings, k: int, q: np.ndarray, bar: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a run (counted from its start) that may reach the bar, and their scores."""
    signs = (q < 0).astype(int)
    terms = np.nonzero(q)[0]
    bounds = np.abs(q[terms]) * postings.most[signs[terms], terms, k]
    order = np.argsort(-bounds, kind="stable")
    terms, bounds = terms[order], bounds[order]
    after = np.append(np.cumsum(bounds[::-1])[::-1], 0)  # bounds of terms i and on together
    if after[0] < bar:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    essential = len(terms) if bar <= 0 else int(np.nonzero(after >= bar)[0][-1]) + 1
    wanted = np.zeros(len(q), np.int64)
    wanted[terms[:essential]] = q[terms[:essential]]
    scores = postings.traverse(k, wanted)
    some = np.nonzero(scores + after[essential] >= bar)[0]  # a row of no essential term has at most `after`, which is below a positive bar
    kept = scores[some]
    for i in range(essential, len(terms)):
        if not len(some):
            break
        d = int(terms[i])
        kept = kept + q[d] * postings.probe(d, k, some)
        if i % PROBES == PROBES - 1:
            on = kept + after[i + 1] >= bar
            some, kept = some[on], kept[on]
    on = kept >= bar
    return some[on], kept[on]


def shard_top(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, bars: np.ndarray | None = None, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of one shard for each query, without those below its bar (nan: no bar)."""
    order = np.argsort(ids, kind="stable")
    return searched(Postings(x[order].astype(np.int64), run), ids[order], query_ids, queries, k, bars)


def searched(postings: Postings, ids: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, bars: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As shard_top, of postings whose rows have these ids, in ascending order."""
    bars = np.full(len(query_ids), np.nan) if bars is None else bars
    out: tuple[list, list, list] = ([], [], [])
    for query_id, q, known in zip(query_ids.tolist(), queries.astype(np.int64), bars.tolist(), strict=True):
        floor = -np.inf if np.isnan(known) else known
        bar, best_ids, best = floor, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for r, start in enumerate(postings.starts):
            some, scores = scored(postings, r, q, bar)
            found = ids[start + some]
            others = found != query_id
            best_ids, best = np.append(best_ids, found[others]), np.append(best, scores[others])
            top = vectors.top(best_ids, best, k, largest=True)
            best_ids, best = best_ids[top], best[top]
            if len(best) == k:
                bar = max(floor, float(best[-1]))
        out[0].append(np.full(len(best), query_id))
        out[1].append(best_ids)
        out[2].append(best)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def top_k(table: DataFrame, is_query: F.Column, k: int = 10, scale: int = 1024, shard: int = vectors.SHARD, block: int = vectors.QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of floor(scale * component) for each query row."""
    found = vectors.usable(table, zero=True).withColumn("v", F.transform("v", lambda x: F.floor(x * float(scale))))

    def best(ids, x, query_ids, queries, bars):
        return shard_top(ids, x, query_ids, queries, k, bars)

    return vectors.search(found, is_query, k, "long", best, largest=True, shard=shard, block=block)
