"""Best-fit packing planned on the histogram of lengths, not on documents.

Documents become token pieces of at most `capacity`. The number of pieces of each length (at most `capacity` counts, whatever the input) goes to the driver, which places whole runs of equal pieces best-fit, longest first. The plan says which ranks within a length go to which sequences and offsets; a piece finds its slot by its rank within its length. Ranks are two-level (within the input partition, then partitions before it), so the most common length is never gathered in one task.

Defined results: null text counts as empty; a document of no text still has its end token, so every row of the input has a piece; repeated rows are packed each on their own; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, common, tokens

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of `capacity` but the first, which may be shorter."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((at, capacity) for at in range(head, n, capacity))]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Rows (length, first rank, first sequence, offset), for runs of equal pieces on neighbouring sequences.

    Best-fit decreasing over counts: among open sequences the ones with the least sufficient room take the run, as many pieces as fit in each; new sequences open only when none has room. Sequences of equal room are kept as id ranges, so steps depend on the number of lengths, not of pieces.
    """
    rooms: list[int] = []
    ranges: dict[int, list[tuple[int, int]]] = {}
    opened, rows = 0, []

    def keep(room: int, lo: int, hi: int) -> None:
        if room and lo < hi:
            if room not in ranges:
                insort(rooms, room)
                ranges[room] = []
            heapq.heappush(ranges[room], (lo, hi))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                lo, hi = heapq.heappop(ranges[room])
                if not ranges[room]:
                    del ranges[room], rooms[at]
            else:
                room, each = capacity, capacity // length
                lo, hi = opened, opened + -(-left // each)
                opened = hi
            each = room // length
            full = min(hi - lo, left // each)
            if full:  # these take as many pieces as fit
                for k in range(each):
                    rows.append((length, rank, lo, capacity - room + k * length))
                    rank += full
                left -= full * each
                keep(room - each * length, lo, lo + full)
                lo += full
            if lo < hi and left and left < each:  # one takes the rest
                for k in range(left):
                    rows.append((length, rank, lo, capacity - room + k * length))
                    rank += 1
                keep(room - left * length, lo, lo + 1)
                left, lo = 0, lo + 1
            keep(room, lo, hi)
    return rows


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of all documents with the input partition and the rank within length there, computed once."""
    common.short_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part, seen, end = bpe.codec(tokenizer_path), TaskContext.get().partitionId(), {}, end_id.to_bytes(4, "little")
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc_id, ids in zip(batch.column(0).to_pylist(), codec.encode_column(batch.column(1)), strict=True):
                ids += end
                for i, (start, length) in enumerate(cut_points(len(ids) // 4, capacity)):
                    local = seen.get(length, 0)
                    seen[length] = local + 1
                    for column, value in zip(out, (doc_id, i, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, local), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"])

    return common.cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(common.released(cut), PIECES))


def pack(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """One row for each piece of each document, with its sequence and its offset there."""
    cut = pieces(docs, tokenizer_path or tokens.public_path("byte_bpe_50k.json"), end_id, capacity)
    by_part = cut.groupBy("part", "length").agg((F.max("local") + 1).alias("n"))
    before = by_part.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    rows = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 4)
    key, sequence, offset = rows[:, 0] << 48 | rows[:, 1], rows[:, 2], rows[:, 3]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(key, length << 48 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence[at] + rank - rows[at, 1]), pa.array(offset[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(before.select("part", "length", "before"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(place, PACKED)
