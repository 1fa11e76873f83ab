"""Overlap of texts with their sources.

With a source given for each text the two stand in one row, and nothing is shuffled. Where the best of all sources is sought, a text walks an automaton of them once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.automaton import automaton
from ..functions.text import gram_counts, normalise, share, shared_text
from ..storage import stored

#: Characters of sources in one automaton (about 230 MB).
MOST_CHARS = 500_000
#: Texts that meet one copy of a group of sources in a task.
TEXTS_OF_TASK = 20_000


def _counted(pairs: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    return pairs.withColumn("_c", gram_counts(F.col("text"), F.col("source"), sizes))


def gram_share(pairs: DataFrame, key: str, n: int) -> DataFrame:
    """(key, total, hits, overlap) of each row of pairs(key, text, source): how many of the text's n-grams, repeats counted, the source holds."""
    c = F.col("_c")[0]
    return _counted(pairs, (n,)).select(key, c.total.alias("total"), c.hits.alias("hits"), share(c).alias("overlap"))


def gated(pairs: DataFrame, key: str, n: int = 6, most_overlap: float = 0.15, most_shared: int = 12) -> DataFrame:
    """(key, overlap, ok) without any dynamic programming: a common substring longer than most_shared is a shared (most_shared + 1)-gram."""
    short, long = F.col("_c")[0], F.col("_c")[1]
    return _counted(pairs, (n, most_shared + 1)).select(key, share(short).alias("overlap"), ((share(short) <= most_overlap) & (long.hits == 0)).alias("ok"))


def longest_shared(pairs: DataFrame, key: str) -> DataFrame:
    """(key, lcs, shared): length and text of the longest common substring."""
    found = pairs.select(key, shared_text(F.col("text"), F.col("source")).alias("shared"))
    return found.select(key, F.length("shared").alias("lcs"), "shared")


def best_source(texts: DataFrame, sources: DataFrame, key: str, source_id: str, most_chars: int = MOST_CHARS) -> DataFrame:
    """(key, source_id, lcs, shared) for each row of texts(key, text): of sources(source_id, text) the one that shares the longest substring with the text, ties to the smaller id, and the earliest such substring; all normalised. Null, 0 and '' where nothing is shared; null texts count as empty, sources without id take no part.

    The sources' characters are counted first. Up to most_chars go to the tasks as one list, and no text is shuffled. More are dealt into groups of about half as many; each text meets every group, in tasks that hold one automaton and stream texts past it, and the best of a text's groups is kept.
    """
    plain = stored(sources.select(F.col(source_id).cast("long").alias("id"), normalise(F.col("text")).alias("source")).where("id is not null and source <> ''").distinct())
    rows = texts.select(key, normalise(F.col("text")).alias("text"))
    chars = plain.agg(F.sum(F.length("source"))).first()[0] or 0
    kind = dict(rows.dtypes)[key]
    if chars <= most_chars:
        return _walked(rows, sorted(map(tuple, plain.collect())), key, kind).withColumnRenamed("id", source_id)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    groups, copies = math.ceil(2 * chars / most_chars), math.ceil(rows.count() / TEXTS_OF_TASK)
    group, copy = F.pmod(F.xxhash64("id", "source"), F.lit(groups)).alias("group"), F.pmod(F.xxhash64("row"), F.lit(max(copies, 1))).alias("copy")
    ours = plain.select(group, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(copies, 1) - 1).cast("long"))).alias("copy"), F.lit(0).alias("part"), "id", F.col("source").alias("text"))
    theirs = rows.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), copy, F.lit(1).alias("part"), F.col("row").alias("id"), "text")
    place = ["group", "copy", "part", "id", "text"]
    met = ours.unionByName(theirs).repartition(groups * max(copies, 1), "group", "copy").sortWithinPartitions(*place)
    found = met.mapInArrow(_met, "row long, lcs int, id long, shared string")
    best = found.groupBy("row").agg(F.max(F.struct("lcs", (-F.col("id")).alias("order"), "shared")).alias("b"))
    return rows.join(best, "row").select(key, (-F.col("b.order")).alias(source_id), "b.lcs", "b.shared")


def _walked(rows: DataFrame, sources: list[tuple[int, str]], key: str, kind: str) -> DataFrame:
    ids, plain = [i for i, _ in sources], tuple(t for _, t in sources)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = automaton(plain)
        for b in batches:
            found = [known.best(t) for t in b.column(1).to_pylist()]
            made = [pa.array([ids[k] if k >= 0 else None for k, _ in found], pa.int64()), pa.array([len(t) for _, t in found], pa.int32()), pa.array([t for _, t in found], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], [key, "id", "lcs", "shared"])

    return rows.mapInArrow(walk, f"{key} {kind}, id long, lcs int, shared string")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of rows (group, copy, part, id, text) against the sources of their group, which come before them."""
    now, ids, plain, known = None, [], [], None
    for b in batches:
        out: list[list] = [[], [], [], []]
        for group, copy, part, row, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (group, copy) != now:
                now, ids, plain, known = (group, copy), [], [], None
            if not part:
                ids.append(row)
                plain.append(text)
                continue
            known = known or automaton(tuple(plain))
            k, shared = known.best(text)
            for column, x in zip(out, (row, len(shared), ids[k] if k >= 0 else None, shared), strict=True):
                column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["row", "lcs", "id", "shared"])
