"""SimHash near-duplicates by tiled exact comparison.

Equal fingerprints are first merged, by an aggregation that Spark pre-aggregates, so a group of copies counts once. The distinct fingerprints are dealt into tiles by the population counts of their four 16-bit parts; two fingerprints within `radius` bits have counts that differ by no more than `radius` in sum, so only tiles of such cells are compared, with numpy's exclusive-or and bit counts. A cell of more than `tile` fingerprints is split in as many tiles as it takes, and each pair of tiles is compared, whatever their number. A pair of tiles returns no more links than join the fingerprints it joins.

Defined results: null text has no words, hence fingerprint zero; a null doc_id keeps its row, and is the component's id only where all its members are null; repeated rows each get their row (keep_first keeps one of them, and rows of one doc_id and unlike texts by their texts); an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components

SEED = 42
PARTS = 4
#: Rows to drop that may be broadcast (16 MB of keys); more are joined by a shuffle of the texts.
FEW = 1_000_000


def fingerprint(text: str | None, words: int = 3) -> int:
    """The fingerprint, 64 bits unsigned: a bit is one if it is one in over half the hashes of the word shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z alone, space and \t to \r alone
    if not found:
        return 0
    if len(found) <= words:
        shingles: Iterator[bytes] = iter([b" ".join(found)])
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) of every row, stored; fp as a signed 64-bit integer."""
    common.short_batches(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t, words) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made)], ["doc_id", "text_hash", "fp"])

    return common.stored(docs.select(F.col("doc_id").cast("long"), common.text_hash().alias("text_hash"), F.col("text").cast("string").alias("text")).mapInArrow(common.released(hashed), "doc_id long, text_hash long, fp long"))


def _cell() -> F.Column:
    """Population counts of the four 16-bit parts, as digits to the base 17."""
    parts = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF)) for k in range(PARTS)]
    return sum(p * 17**k for k, p in enumerate(parts)).cast("int")


def _near(radius: int) -> list[tuple[int, ...]]:
    """Differences of four counts, of no more than radius in sum."""
    return [d for d in itertools.product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, d)) <= radius]


def links(distinct: DataFrame, radius: int = 2, tile: int = 4096) -> DataFrame:
    """distinct(fp), each once: links (a, b) that join whatever lies within radius bits of each other."""
    cells = {r.cell: r.n for r in distinct.groupBy(_cell().alias("cell")).agg(F.count("*").alias("n")).collect()}  # at most 17**4 rows
    tiles = {c: -(-n // tile) for c, n in cells.items()}
    first = dict(zip(sorted(tiles), itertools.accumulate((tiles[c] for c in sorted(tiles)), initial=0), strict=False))
    near = _near(radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, mixed = b.column(1).to_pylist(), b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([first[c] + h % tiles[c] for c, h in zip(cell, mixed, strict=True)], pa.int64()), b.column(1), b.column(0)], ["tile", "cell", "fp"])

    dealt = distinct.select("fp", _cell().alias("cell"), F.xxhash64("fp").alias("mixed")).mapInArrow(deal, "tile long, cell int, fp long")
    full = common.stored(dealt.groupBy("tile", "cell").agg(F.collect_list("fp").alias("fps")))  # at most about `tile` of them

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, cell, fps in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                digits = [cell // 17**k % 17 for k in range(PARTS)]
                others = []
                for d in near:
                    at = [x + y for x, y in zip(digits, d, strict=True)]
                    if min(at) >= 0 and max(at) <= 16 and (c := sum(x * 17**k for k, x in enumerate(at))) >= cell and c in first:
                        others += [t for t in range(first[c], first[c] + tiles[c]) if t >= own]
                for at in range(0, len(others), 64):
                    part = others[at : at + 64]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([own] * len(part), pa.int64()), pa.array([fps.as_py()] * len(part), pa.list_(pa.int64()))], ["tile", "own", "fps"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forest = components.Forest()
            for other, own, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                for at in range(0, len(x), 512):
                    apart = (x[at : at + 512, None] ^ y[None, :]).view(np.uint64)  # of signed integers numpy counts the absolute value's bits
                    i, j = np.nonzero(np.bitwise_count(apart) <= radius)
                    if other == own:
                        i, j = i[i + at < j], j[i + at < j]
                    for a, c in zip(x[at + i].tolist(), y[j].tolist(), strict=True):
                        forest.link(a, c)
            yield components._rows(forest)

    pairs = full.mapInArrow(common.released(spread), "tile long, own long, fps array<long>").join(full.select("tile", F.col("fps").alias("others")), "tile")
    return pairs.mapInArrow(common.released(compare), components.LINKS)


def classed(docs: DataFrame, radius: int, words: int, tile: int) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) of every row; root numbers the components, component_id is the least doc_id that links reach."""
    prints = fingerprints(docs, words)
    distinct = common.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("doc")))
    roots = components.label(links(distinct.select("fp"), radius, tile))
    rooted = distinct.join(roots.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select("fp", "doc", F.coalesce("root", "fp").alias("root"))
    rooted = common.stored(rooted)
    least = common.stored(rooted.groupBy("root").agg(F.min("doc").alias("component_id"), F.count("*").alias("n")).where("n > 1").select("root", "component_id"))
    merged = common.stored(rooted.join(least, "root", "left").select("fp", "root", F.coalesce("component_id", "doc").alias("component_id")))
    return prints.join(merged, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3, tile: int = 4096) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) of every row; component_id is the least doc_id that links reach."""
    return classed(docs, radius, words, tile).select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = 2, words: int = 3, tile: int = 4096) -> DataFrame:
    """docs, all columns, with one row of each component: that of the least doc_id."""
    return without_copies(docs, classed(docs, radius, words, tile))


def without_copies(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with one row of each root in found(doc_id, text_hash, root): that of the least doc_id, among unlike texts of that id the one of the least hash. Rows without a doc_id all stay; of rows that repeat both doc_id and text one stays."""
    found = common.stored(found.where("doc_id is not null").select("doc_id", "text_hash", "root"))
    key = ["doc_id", "text_hash"]
    first = common.stored(found.groupBy("root").agg(F.min(F.struct(*key)).alias("first"), F.count("*").alias("n")).where("n > 1").select("root", "first.*", "n"))
    in_group = found.join(first.select("root"), "root", "left_semi").select(*key)
    gone = common.stored(in_group.join(first.select(*key), key, "left_anti").distinct())
    gone = gone.toDF("__doc_id", "__text_hash")
    if gone.count() <= FEW:
        gone = F.broadcast(gone)
    mine = docs.withColumns({"__doc_id": F.col("doc_id").cast("long"), "__text_hash": common.text_hash()})
    kept = mine.join(gone, ["__doc_id", "__text_hash"], "left_anti")
    twice = common.stored(in_group.join(first.select(*key), key, "left_semi").groupBy(*key).count().where("count > 1").select(F.col("doc_id").alias("__doc_id"), F.col("text_hash").alias("__text_hash")))
    if not twice.limit(1).count():
        return kept.select(docs.columns)
    again = kept.join(twice, ["__doc_id", "__text_hash"], "left_semi").dropDuplicates(["__doc_id", "__text_hash"]).select(docs.columns)
    return kept.join(twice, ["__doc_id", "__text_hash"], "left_anti").select(docs.columns).unionByName(again)
