"""Near-duplicate documents at a stated similarity: SimHash candidates by tiled exact comparison, then the exact similarity.

A document's sketch is four SimHash fingerprints of its distinct word shingles, 256 bits. Documents of equal sketches and equal hashes of the shingle set form a class, found by a pre-aggregated minimum; equal sketches alone are a distance of 0 between classes, to be verified as any other. Classes are dealt into tiles by the number of their shingles (in steps of a twelfth) and within such a step by the population count of the first fingerprint. Two tiles are compared only if their shingle counts allow the similarity (the smaller set must have `least` times as many as the larger) and their population counts differ by no more than `radius`; neither rule can lose a pair. A pair of tiles is compared with numpy's exclusive-or and bit counts: the first fingerprints must be within `radius` bits, the whole sketches within `wide` bits. Of what is close, a pair of tiles returns a spanning forest, so a group of any size returns fewer links than members, and the forests together join whatever is close.

The forest's links only say which classes can be similar: each of its components is then compared within, on the shingle sets themselves. Two close members not yet joined are joined if the Jaccard similarity of their sets is at least `least`, so every close pair is either verified or joined by verified links. Those links' components are the groups. A large component is split into parts by its shingles and by the root of its members, and each pair of parts compared by a task of its own.

At a similarity of 0.8 the first fingerprints differ in 9.7 bits and the sketches in 38.8, give or take 2.9 and 5.7; the defaults leave 3.5 and 4.4 of these deviations.

Defined results: null text has no words, and all documents without words are alike; fewer words than a shingle count as one shingle; rows with a null doc_id are kept, as no id can stand for them; rows that repeat a doc_id with another text count by their text, and of rows that repeat both one stays; an empty table gives no rows; all columns are kept.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components

LANES = ("s0", "s1", "s2", "s3")
#: What the members of a class share: the sketch, and the hash of the shingle set.
CLASS = (*LANES, "h")
#: Bits within which two classes are verified: of the first fingerprint, and of the sketch.
RADIUS, WIDE = 20, 64
#: Bounds that no sketch passes: groups(docs, **EXACT) and keep_first(docs, **EXACT) verify every pair that the numbers of shingles allow, and lose none. Work then grows with the square of the documents of like length, so it is for small tables and for measuring what the defaults lose.
EXACT = {"radius": 64, "wide": 256}
#: Classes in a tile (3 MB); each tile is sent to all it is compared with, so larger tiles move less.
TILE = 65_536
#: Pairs that numpy compares at once, and classes that one batch of tiles holds.
AT_ONCE, IN_BATCH = 2_097_152, 131_072
#: Ids with sketches that may be broadcast (56 MB); more are joined by a shuffle.
FEW = 1_000_000
#: Shingles (8 bytes each) in a part of a component of close classes; a task holds two parts. Members of a component of one part.
MOST, MEMBERS = 2_000_000, 512
#: Steps of shingle counts to a doubling.
STEPS = 8
#: Odd multipliers, one for each place in a shingle, and what tells the lanes apart.
_MULTIPLY = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 2**64) for i in range(64)], np.uint64)
_LANE = np.array([xxhash.xxh3_64_intdigest(f"lane {k}") for k in range(4)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit integers, each bit made to depend on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, words: int = 5) -> np.ndarray:
    """Unsigned hashes of the distinct word shingles, sorted. A-Z in lower case, words between ASCII white space; a shingle's hash is a sum of its words' hashes, each times its place's multiplier."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    words = min(words, len(found))
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(found) - words + 1
    total = np.full(n, words, np.uint64)
    for i in range(words):
        total += each[i : i + n] * _MULTIPLY[i]
    return np.unique(mixed(total))


def sketch(text: str | None, words: int = 5) -> np.ndarray:
    """Four fingerprints, as unsigned 64-bit integers; a bit is one if it is one in over half the hashes of the distinct shingles."""
    return described(text, words)[:4]


def described(text: str | None, words: int = 5) -> np.ndarray:
    """The sketch, the hash of the shingle set (the sum of its hashes) and the number of distinct shingles."""
    distinct = shingle_hashes(text, words)
    ones = np.zeros(256, np.int64)
    for at in range(0, len(distinct), 2048):
        lanes = mixed(distinct[at : at + 2048, None] ^ _LANE)
        ones += np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(-1, 32), axis=1).sum(axis=0, dtype=np.uint16)
    return np.concatenate([np.packbits(ones * 2 > len(distinct)).view("<u8"), distinct.sum(dtype=np.uint64, keepdims=True), [np.uint64(len(distinct))]])


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Hashes of the distinct shingles, as signed integers."""
    return shingle_hashes(text, words).view(np.int64)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, sketch, set hash and number of shingles) of every row, stored."""
    common.short_batches(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([described(t, words) for t in b.column(2).to_pylist()], np.uint64).reshape(-1, 6).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(s[:, k].copy()) for k in range(6))], ["doc_id", "text_hash", *CLASS, "n"])

    text = F.col("text").cast("string")
    return common.stored(docs.select(F.col("doc_id").cast("long"), common.text_hash().alias("text_hash"), text.alias("text")).mapInArrow(common.released(made), "doc_id long, text_hash long, s0 long, s1 long, s2 long, s3 long, h long, n long"))


def spanning(ends: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which of the links (a row of two places each, any number of them) make a minimum spanning forest by far."""
    order = np.argsort(far, kind="stable")
    ends, taken, forest, size = ends[order], [], components.Forest(), 256
    label = np.arange(int(ends.max()) + 1 if len(ends) else 0)
    left = np.arange(len(ends))
    while len(left):
        now, left = left[:size], left[size:]
        for i, (a, b) in zip(now.tolist(), ends[now].tolist(), strict=True):
            if forest.root(a) != forest.root(b):
                forest.link(a, b)
                taken.append(i)
        for x in list(forest.up):
            label[x] = forest.root(x)
        left = left[label[ends[left, 0]] != label[ends[left, 1]]]
        size *= 2
    return order[taken]


def close(x: np.ndarray, y: np.ndarray, same: bool, radius: int, wide: int, sizes: tuple[np.ndarray, np.ndarray] | None = None, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Places in x and y of a spanning forest of what is close; x and y hold four lanes a row, sizes their numbers of shingles, of which the smaller must be at least `least` times the larger."""
    x, y = np.ascontiguousarray(x).view(np.uint64), np.ascontiguousarray(y).view(np.uint64)  # of signed integers numpy counts the absolute value's bits
    shift = 0 if same else len(x)
    label, out, joined = np.arange(shift + len(y)), [np.zeros((0, 2), np.int64)], False
    head, every = np.ascontiguousarray(y[:, 0]), max(1, AT_ONCE // max(1, len(y)))
    for at in range(0, len(x), every):
        near = np.bitwise_count(x[at : at + every, :1] ^ head[None, :]) <= radius
        if joined:
            near &= label[at : at + every][: len(near), None] != label[None, shift:]  # what is joined needs no other link
        i, j = np.nonzero(near)
        i = i + at
        if same:
            i, j = i[i < j], j[i < j]
        if sizes is not None and len(i):
            a, b = sizes[0][i], sizes[1][j]
            on = np.minimum(a, b) >= least * np.maximum(a, b)
            i, j = i[on], j[on]
        d = sum(np.bitwise_count(x[i, k] ^ y[j, k]).astype(np.int64) for k in range(4))
        i, j, d = i[d <= wide], j[d <= wide], d[d <= wide]
        if len(i):
            ends = np.column_stack([label[i], label[j + shift]])
            kept = spanning(ends, d)
            out.append(np.column_stack([i[kept], j[kept]]))
            forest = components.Forest()
            for a, b in ends[kept].tolist():
                forest.link(a, b)
            root = np.arange(len(label))
            root[list(forest.up)] = [forest.root(a) for a in list(forest.up)]
            label, joined = root[label], True
    found = np.vstack(out)
    return found[:, 0], found[:, 1]


def step_of(n: F.Column) -> F.Column:
    """The step of a number of shingles."""
    return F.floor(F.log2(n + 1) * STEPS).cast("int")


def steps_apart(least: float) -> int:
    """How many steps apart sets of this similarity can be."""
    return math.floor(-math.log2(least) * STEPS) + 2 if least > 0 else 64 * STEPS


class Tiles:
    """The plan of tiles from the number of classes of each step and population count: at most 64 * STEPS * 65 entries, whatever the input."""

    def __init__(self, counts: dict[tuple[int, int], int], tile: int):
        self.bounds: list[tuple[int, int, int]] = []  # of each tile: step, least and largest population count
        self.first: dict[tuple[int, int], tuple[int, int]] = {}  # first tile of a step and population count, and number of tiles it is dealt to
        held = 0
        for (step, ones), n in sorted(counts.items()):
            if n > tile:
                self.first[step, ones] = (len(self.bounds), -(-n // tile))
                self.bounds += [(step, ones, ones)] * -(-n // tile)
                held = tile
            elif self.bounds and self.bounds[-1][0] == step and held + n <= tile:
                self.bounds[-1] = (step, self.bounds[-1][1], ones)
                self.first[step, ones] = (len(self.bounds) - 1, 1)
                held += n
            else:
                self.first[step, ones] = (len(self.bounds), 1)
                self.bounds.append((step, ones, ones))
                held = n
        self.of_step: dict[int, list[int]] = {}
        for t, (step, _, _) in enumerate(self.bounds):
            self.of_step.setdefault(step, []).append(t)

    def partners(self, own: int, radius: int, apart: int) -> list[int]:
        """The tiles, itself and later ones, that a tile is compared with."""
        step, lo, hi = self.bounds[own]
        near = (t for s in range(step, step + apart + 1) for t in self.of_step.get(s, ()) if t >= own)
        return [t for t in near if self.bounds[t][1] <= hi + radius and lo <= self.bounds[t][2] + radius]


def candidates(classes: DataFrame, radius: int, wide: int, tile: int, least: float) -> DataFrame:
    """classes(node, s0 to s3, n): links (a, b) of close ones."""
    ones = F.bit_count("s0").cast("int")
    counts = {(r.step, r.ones): r.c for r in classes.groupBy(step_of(F.col("n")).alias("step"), ones.alias("ones")).agg(F.count("*").alias("c")).collect()}  # bounded, see Tiles
    tiles, apart = Tiles(counts, tile), steps_apart(least)
    member = ("node", *LANES, "n")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = [first + h % k for (first, k), h in ((tiles.first[s, o], h) for s, o, h in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), *b.columns[3:]], ["tile", *member])

    dealt = classes.select(step_of(F.col("n")).alias("step"), ones.alias("ones"), F.xxhash64("s0", "node").alias("mixed"), *member)
    dealt = dealt.mapInArrow(deal, "tile long, " + ", ".join(f"{c} long" for c in member))
    full = common.stored(dealt.groupBy("tile").agg(F.collect_list(F.struct(*member)).alias("cs")))  # `tile` of them at most
    row = "array<struct<" + ",".join(f"{c}:bigint" for c in member) + ">>"
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in member]))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, own in enumerate(b.column(0).to_pylist()):
                others, each = tiles.partners(own, radius, apart), max(1, IN_BATCH // len(b.column(1)[k]))
                for lo in range(0, len(others), each):
                    part = others[lo : lo + each]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([own] * len(part), pa.int64()), b.column(1).take(pa.array([k] * len(part))).cast(kind)], ["tile", "own", "cs"])

    def lanes(cs: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fields = [f.to_numpy(zero_copy_only=False) for f in cs.values.flatten()]
        return fields[0], np.column_stack(fields[1:5]), fields[5]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for other, own, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                (x_ids, x, x_n), (y_ids, y, y_n) = lanes(x), lanes(y)
                i, j = close(x, y, other == own, radius, wide, (x_n, y_n), least)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(x_ids[i]), pa.array(y_ids[j])], ["a", "b"])

    pairs = full.mapInArrow(common.released(spread), f"tile long, own long, cs {row}").join(full.select("tile", F.col("cs").alias("others")), "tile")
    return pairs.mapInArrow(common.released(compare), components.LINKS)


def similar(node: np.ndarray, part: np.ndarray, lanes: np.ndarray, sets: list[np.ndarray], radius: int, wide: int, least: float) -> list[tuple[int, int]]:
    """Links of a Jaccard similarity of `least` or more that join whatever close pairs have it: between two parts, or within a single one."""
    lanes = np.ascontiguousarray(lanes).view(np.uint64)
    size = np.array([len(s) for s in sets], np.int64)
    start = np.cumsum(size) - size
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    marked, label, out = np.zeros(len(values), bool), np.arange(len(node)), []
    across = part.min() != part.max()
    for i in range(len(node) - 1):
        j = i + 1 + np.nonzero(label[i + 1 :] != label[i])[0]
        if not len(j):
            continue
        j = j[np.minimum(size[j], size[i]) >= least * np.maximum(size[j], size[i])]
        j = j[np.bitwise_count(lanes[j, 0] ^ lanes[i, 0]) <= radius]
        j = j[np.bitwise_count(lanes[j] ^ lanes[i]).sum(axis=1, dtype=np.int64) <= wide]
        if across:
            j = j[part[j] != part[i]]
        own = flat[start[i] : start[i] + size[i]]
        marked[own] = True
        for at in range(0, len(j), 256):
            some = j[at : at + 256]
            shared = np.array([np.count_nonzero(marked[flat[start[k] : start[k] + size[k]]]) for k in some.tolist()], np.int64)
            for k in some[shared >= least * (size[i] + size[some] - shared)].tolist():
                if label[k] != label[i]:
                    out.append((int(node[i]), int(node[k])))
                    label[label == label[k]] = label[i]
        marked[own] = False
    return out


def verified(docs: DataFrame, classes: DataFrame, links: DataFrame, words: int, least: float, radius: int, wide: int) -> DataFrame:
    """Links (a, b) of a Jaccard similarity of `least` or more that join every close pair which has it; links(a, b) join whatever is close."""
    members = common.stored(with_roots(components.label(links)).join(classes, "node"))
    parts = common.stored(members.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / MOST), F.ceil(F.sqrt(F.count("*") / MEMBERS))).cast("long").alias("parts")))
    ends = common.stored(members.join(parts, "root").select("doc", "root", "parts", "node", *CLASS))
    if ends.count() <= FEW:
        ends = F.broadcast(ends)
    needed = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string")).join(ends, "doc").select("root", "parts", "node", *LANES, "h", "text")
    row = "root long, parts long, node long, s0 long, s1 long, s2 long, s3 long, set array<long>"

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [shingle_set(t, words) for t in b.column(8).to_pylist()]
            own = pa.array([int(x.sum()) == h for x, h in zip(made, b.column(7).to_pylist(), strict=True)], pa.bool_())  # of rows that repeat a doc_id those of the class
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(made, pa.list_(pa.int64()))], ["root", "parts", "node", *LANES, "set"]).filter(own)

    made = needed.mapInArrow(common.released(sets), row).withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    sent = made.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    sent = sent.select("root", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "node", *LANES, "set")
    sent = sent.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links_of(held: dict) -> pa.RecordBatch:
            at = list(held)
            found = similar(np.array(at), np.array([held[c][0] for c in at]), np.array([held[c][1] for c in at], np.int64), [held[c][2] for c in at], radius, wide, least) if len(at) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        key, held = None, {}
        for b in batches:
            plain = [b.column(k).to_pylist() for k in range(9)]
            for *own, part, node, s0, s1, s2, s3, values in zip(*plain, b.column(9), strict=True):
                if own != key:
                    yield links_of(held)
                    key, held = own, {}
                if node not in held:  # repeated rows count once
                    held[node] = (part, (s0, s1, s2, s3), values.values.to_numpy().copy())
        yield links_of(held)

    return sent.mapInArrow(common.released(compare), components.LINKS)


def with_roots(labels: DataFrame) -> DataFrame:
    """(node, root) of every node that has a label (a, b), roots included."""
    return labels.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(labels.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def classed(docs: DataFrame, words: int, least: float, radius: int, wide: int, tile: int) -> DataFrame:
    """(doc_id, text_hash, root, component_id) of every row; root numbers the groups, component_id is the least doc_id of the group."""
    rows = sketches(docs, words)
    classes = rows.groupBy(*CLASS).agg(F.min("doc_id").alias("doc"), F.max("n").alias("n"))
    classes = common.stored(classes.withColumn("node", F.monotonically_increasing_id()))  # stored, so numbers stay
    links = common.stored(candidates(classes.where("doc is not null"), radius, wide, tile, least))
    linked = common.stored(with_roots(components.label(verified(docs, classes, links, words, least, radius, wide))))
    least_doc = linked.join(classes.select("node", "doc"), "node").groupBy("root").agg(F.min("doc").alias("component_id"))
    linked = common.stored(linked.join(least_doc, "root").select("node", "root", "component_id"))
    named = classes.join(linked, "node", "left").select(*CLASS, F.coalesce("root", "node").alias("root"), F.coalesce("component_id", "doc").alias("component_id"))
    return rows.join(common.stored(named), list(CLASS)).select("doc_id", "text_hash", "root", "component_id")


def groups(docs: DataFrame, words: int = 5, least: float = 0.8, radius: int = RADIUS, wide: int = WIDE, tile: int = TILE) -> DataFrame:
    """(doc_id, component_id) of every row of docs(doc_id, text); component_id is the least doc_id of its group, null where all ids are."""
    return classed(docs, words, least, radius, wide, tile).select("doc_id", "component_id")


def keep_first(docs: DataFrame, words: int = 5, least: float = 0.8, radius: int = RADIUS, wide: int = WIDE, tile: int = TILE) -> DataFrame:
    """docs with one row of each group: that of the least doc_id."""
    from .simhash import without_copies

    return without_copies(docs, classed(docs, words, least, radius, wide, tile))
