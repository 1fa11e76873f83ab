"""Near-duplicates of embeddings by an epsilon grid order join.

Unit vectors have a cosine of at least t if they lie within epsilon = sqrt(2 - 2t) of each other, and their shadows on any axes lie no further apart. Vectors are turned to their principal axes (found from the moments of all vectors; no sample), and put in the order of the grid cells, epsilon wide, of the first of these axes. The sequence is dealt into blocks of neighbours, each with the box around its shadows on the leading axes; blocks form intervals, eight to one, up to the whole. Pairs of intervals are split recursively, a join for each level, and a pair whose boxes lie further apart than epsilon goes with all that is in it. What is left are pairs of blocks, which a task splits on the same way down to a few hundred vectors, and compares by one matrix product. Skipping is exact: no pair of a cosine of t or more is lost.

Equal vectors are merged first, by a digest that Spark pre-aggregates, and count with their number. A pair of blocks returns, of each vector, how many it is linked to, and no more links than join what they join: a dense group is counted in full, but never written out as pairs.

Cosines within 1e-9 of t are computed anew from the vectors as they are, with exact sums, so links don't depend on how vectors fall into blocks.

Defined results: a vector that is null, empty, zero or holds null or non-finite components links with nothing, nor do vectors of unlike sizes; each of repeated rows gets its row and links with its copies; rows without vec_id are vectors too, and name no component (one of such rows alone has none); an empty table gives no rows; columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import scan
from . import common, components, vectors

#: Axes that order the grid, and axes of the boxes.
GRID, BOX = 6, 16
#: Vectors of a block at most, bytes of a block's doubles at most, vectors that are compared at once, intervals to one of the next level, blocks that meet another in one task.
BLOCK, BLOCK_BYTES, LEAF, FAN, PARTNERS = 4096, 2**21, 256, 8, 4
#: Vectors of a size get principal axes if they are of the most frequent sizes and not longer than this; others are ordered by their first components.
SIZES, LONGEST = 4, 1024
SLACK = 1e-9


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    dot = lambda a, b: math.fsum((a * b).tolist())
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))


def marked(table: DataFrame) -> DataFrame:
    """(vec_id, v, size, key) of every row; key is a digest of v, null if v links with nothing."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long"), v.alias("v")).select("vec_id", F.when(F.coalesce(usable, F.lit(False)), F.transform("v", lambda x: x + 0.0)).alias("v"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [None if x is None else np.array(x).tobytes() for x in b.column(1).to_pylist()]
            keys = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in found]
            sizes = [None if x is None else len(x) // 8 for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary())], ["vec_id", "v", "size", "key"])

    return rows.mapInArrow(digests, "vec_id long, v array<double>, size int, key binary")


def axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes (size x BOX) of the unit vectors of the most frequent sizes, from the sums of all their products; at most SIZES * LONGEST**2 numbers come to the driver."""
    sizes = [r.size for r in classes.where(F.col("size") <= LONGEST).groupBy("size").count().orderBy(F.desc("count"), "size").limit(SIZES).collect()]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            t = pa.Table.from_batches([b])
            of = b.column(0).to_numpy()
            for size in np.unique(of).tolist():
                u = units(vectors.matrix(t.filter(pa.array(of == size))))
                u = np.hstack([u, np.ones((len(u), 1))])  # the last row and column sum the vectors themselves
                sums[size] = sums.get(size, 0) + u.T @ u
        for size, m in sums.items():
            for i, row in enumerate(m):
                yield pa.RecordBatch.from_arrays([pa.array([size] * len(row), pa.int32()), pa.array([i] * len(row), pa.int32()), pa.array(range(len(row)), pa.int32()), pa.array(row)], ["size", "i", "j", "x"])

    of_sizes = classes.where(F.col("size").isin(sizes)).select("size", "v") if sizes else classes.limit(0).select("size", "v")
    found = of_sizes.mapInArrow(moments, "size int, i int, j int, x double").groupBy("size", "i", "j").agg(F.sum("x").alias("x")).toArrow()
    made = {}
    for size in sizes:
        part = found.filter(pa.array(found.column("size").to_numpy() == size))
        m = np.zeros((size + 1, size + 1))
        m[part.column("i").to_numpy(), part.column("j").to_numpy()] = part.column("x").to_numpy()
        mean = m[-1, :-1] / m[-1, -1]
        _, found_axes = np.linalg.eigh(m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean))
        made[size] = np.ascontiguousarray(found_axes[:, ::-1][:, :BOX])
    return made


def shadows(u: np.ndarray, basis: dict[int, np.ndarray]) -> np.ndarray:
    """Places of unit vectors on the leading axes; BOX of them, zeros where there are fewer."""
    size = u.shape[1]
    placed = u @ basis[size] if size in basis else u[:, :BOX]
    return np.hstack([placed, np.zeros((len(u), BOX - placed.shape[1]))])


def numbered(classes: DataFrame, basis: dict[int, np.ndarray], epsilon: float) -> DataFrame:
    """classes(size, key, first, copies, v) with rank, their place in the order of the grid."""

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            of, cells = b.column("size").to_numpy(), np.zeros((b.num_rows, GRID), np.int32)
            for size in np.unique(of).tolist():
                cells[of == size] = np.floor(shadows(units(vectors.matrix(t.filter(pa.array(of == size)))), basis)[:, :GRID] / epsilon)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(cells), pa.list_(pa.int32()))], [*b.schema.names, "cell"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int64()), pa.array(range(at, at + b.num_rows), pa.int64())], [*b.schema.names, "part", "at"])
            at += b.num_rows

    schema = "size int, key binary, first long, copies long, v array<double>"
    order = ["size", "cell", "key"]  # the digest splits a cell that holds very many
    ordered = classes.select("size", "key", "first", "copies", "v").mapInArrow(celled, f"{schema}, cell array<int>").repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = common.stored(ordered.drop("cell").mapInArrow(placed, f"{schema}, part long, at long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range, however many vectors there are
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return dealt.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("at")).drop("part", "at", "start")


def blocks(classes: DataFrame, basis: dict[int, np.ndarray], epsilon: float, block: int) -> DataFrame:
    """The sequence in blocks, stored: rank (from 0), size, ids (places in the sequence), keys, first (vec_ids, the least of each class), copies, data (the vectors), and the bounds l0, h0, ... of the box."""
    bounds = [f"{side}{k}" for k in range(BOX + 1) for side in "lh"]

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def made() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            x, size = vectors.matrix(t), now[0]
            near = np.hstack([shadows(units(x), basis), np.full((len(x), 1), 4.0 * size)])  # vectors of other sizes are far
            box = [y for k in range(BOX + 1) for y in (near[:, k].min(), near[:, k].max())]
            small = x.astype("<f4")
            data = b"f" + small.tobytes() if np.array_equal(small, x) else b"d" + x.astype("<f8").tobytes()
            held.clear()
            lists = [pa.array([t.column(c).to_pylist()], pa.list_(kind)) for c, kind in (("rank", pa.int64()), ("key", pa.binary()), ("first", pa.int64()), ("copies", pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([now[1]], pa.int64()), *lists, pa.array([data], pa.binary()), *(pa.array([float(y)]) for y in box)], ["size", "no", "ids", "keys", "first", "copies", "data", *bounds])

        for b in batches:
            sizes, numbers = b.column("size").to_numpy(), b.column("no").to_numpy()
            edges = np.nonzero((np.diff(sizes) != 0) | (np.diff(numbers) != 0))[0] + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
                if start == end:
                    continue
                name = (int(sizes[start]), int(numbers[start]))
                if held and name != now:
                    yield made()
                now = name
                held.append(b.slice(start, end - start))
        if held:
            yield made()

    ranked = numbered(classes, basis, epsilon)
    bytes_bound = F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("size")))
    most = F.greatest(F.lit(64), F.least(F.lit(block), bytes_bound)) if block > 64 else F.lit(block)
    cut = ranked.withColumn("no", F.floor(F.col("rank") / most))
    wanted = classes.groupBy("size").agg(F.count("*").alias("n")).agg(F.sum(F.ceil(F.col("n") / most))).first()[0] or 1
    dealt = cut.repartition(max(1, min(int(wanted), 10_000)), "size", "no").sortWithinPartitions("size", "no", "rank")
    schema = "size int, no long, ids array<long>, keys array<binary>, first array<long>, copies array<long>, data binary, " + ", ".join(f"{x} double" for x in bounds)
    made = common.stored(dealt.mapInArrow(common.released(gathered), schema))
    order = scan.running(made.select("size", "no", F.lit(0).alias("all")), ["all"], [F.col("size"), F.col("no")], {"rank": F.lit(1)})
    return made.join(order.select("size", "no", (F.col("rank") - 1).alias("rank")), ["size", "no"]).drop("no")


def apart(x: str, y: str) -> F.Column:
    """The square of the distance of two boxes."""
    gaps = [F.greatest(F.lit(0.0), F.col(f"{x}.l{k}") - F.col(f"{y}.h{k}"), F.col(f"{y}.l{k}") - F.col(f"{x}.h{k}")) for k in range(BOX + 1)]
    return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])


def block_pairs(sequence: DataFrame, epsilon: float) -> DataFrame:
    """(x, y): ranks x <= y of blocks that may hold vectors within epsilon, by recursion over pairs of intervals of the sequence."""
    sides = [f"{s}{k}" for k in range(BOX + 1) for s in "lh"]
    boxes = [common.stored(sequence.select(F.col("rank").alias("i"), *sides))]
    n = boxes[0].count()
    while n > 1:
        wider = boxes[-1].groupBy(F.floor(F.col("i") / FAN).alias("i")).agg(*[(F.min if s[0] == "l" else F.max)(s).alias(s) for s in sides])
        boxes.append(common.stored(wider))
        n = -(-n // FAN)
    pairs = boxes[-1].select(F.col("i").alias("x"), F.col("i").alias("y"))
    for level in reversed(boxes[:-1]):
        one = level.select(F.floor(F.col("i") / FAN).alias("x"), F.struct("i", *sides).alias("p"))
        two = level.select(F.floor(F.col("i") / FAN).alias("y"), F.struct("i", *sides).alias("q"))
        met = pairs.join(one, "x").join(two, "y").where(F.col("p.i") <= F.col("q.i"))
        pairs = common.stored(met.where(apart("p", "q") <= epsilon * epsilon + SLACK).select(F.col("p.i").alias("x"), F.col("q.i").alias("y")))
    return pairs


def stars(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that join what a true cell joins, row i being a[i] and column j being b[j]: each member of a component and one of its rows."""
    rows, columns, members, roots = near.any(axis=1), np.zeros(near.shape[1], bool), [], []
    for start in np.nonzero(rows)[0].tolist():
        if not rows[start]:
            continue
        front = np.array([start])
        rows[start] = False
        while len(front):
            reached = np.nonzero(near[front].any(axis=0) & ~columns)[0]
            columns[reached] = True
            found = b[reached]
            members += found[found != a[start]].tolist()
            front = np.nonzero(near[:, reached].any(axis=1) & rows)[0] if len(reached) else reached
            rows[front] = False
            members += a[front].tolist()
        roots += [int(a[start])] * (len(members) - len(roots))
    return members, roots


class Block:
    """A block in a task: its vectors, their units and shadows, and the boxes of its leaves."""

    def __init__(self, row: dict, basis: dict[int, np.ndarray]):
        kind, n = ("<f4" if row["data"][:1] == b"f" else "<f8"), len(row["ids"])
        self.raw = np.frombuffer(row["data"], kind, offset=1).reshape(n, row["size"]).astype(float)
        self.ids, self.copies = np.array(row["ids"]), np.array(row["copies"], float)
        self.units = units(self.raw)
        placed = shadows(self.units, basis)
        starts = np.arange(0, n, LEAF)
        self.low, self.high = np.minimum.reduceat(placed, starts), np.maximum.reduceat(placed, starts)
        self.leaves, self.n = len(starts), n


def compared(x: Block, y: Block, least: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Which pairs of two blocks link, how many vectors each links to in the other, and how many pairs were compared; of a block with itself a pair counts in both of its cells."""
    reach = 2 - 2 * least + SLACK
    near, pairs = np.zeros((x.n, y.n), bool), 0

    def join(a: int, b: int, c: int, d: int) -> None:
        """Leaves a to b of x with c to d of y."""
        nonlocal pairs
        if same and d <= a:
            return
        gap = np.maximum(0, np.maximum(x.low[a:b].min(axis=0) - y.high[c:d].max(axis=0), y.low[c:d].min(axis=0) - x.high[a:b].max(axis=0)))
        if gap @ gap > reach:
            return
        if b - a == 1 and d - c == 1:
            left, right = slice(a * LEAF, b * LEAF), slice(c * LEAF, d * LEAF)
            cosines = x.units[left] @ y.units[right].T
            found = cosines >= least
            for i, j in zip(*np.nonzero(np.abs(cosines - least) < SLACK), strict=True):
                found[i, j] = exact_cosine(x.raw[a * LEAF + i], y.raw[c * LEAF + j]) >= least
            near[left, right] = found
            pairs += found.size
            if same:
                near[right, left] = found.T
            return
        rows, columns = [(a, b)] if b - a == 1 else [(a, (a + b) // 2), ((a + b) // 2, b)], [(c, d)] if d - c == 1 else [(c, (c + d) // 2), ((c + d) // 2, d)]
        for one in rows:
            for two in columns:
                join(*one, *two)

    join(0, x.leaves, 0, y.leaves)
    if same:
        np.fill_diagonal(near, False)
    return near, near @ y.copies, x.copies @ near, pairs


def links(sequence: DataFrame, pairs: DataFrame, basis: dict[int, np.ndarray], least: float) -> DataFrame:
    """Stored rows (a, b, n): a and b are linked (n is 0), or a links to n vectors of another class (b is null)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, name = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("x", "y", "chunk", "own", "size", "ids", "copies", "data")}
                block = Block(row, basis)
                if row["own"]:
                    own, name = block, (row["x"], row["chunk"])
                    continue
                if name != (row["x"], row["chunk"]):
                    raise ValueError("a block came without the one it is compared with")
                if own.raw.shape[1] != block.raw.shape[1]:
                    continue
                same = row["x"] == row["y"]
                near, mine, theirs, _ = compared(own, block, least, same)
                if not near.any():
                    continue
                members, roots = stars(near, own.ids, block.ids)
                sides = [(own.ids, mine)] if same else [(own.ids, mine), (block.ids, theirs)]
                ids = np.concatenate([i[n > 0] for i, n in sides])
                counts = np.concatenate([n[n > 0] for _, n in sides]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(members, pa.int64()), pa.array(roots, pa.int64()), pa.array([0] * len(roots), pa.int64())], ["a", "b", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([None] * len(ids), pa.int64()), pa.array(counts)], ["a", "b", "n"])

    met = pairs.withColumn("chunk", F.floor(F.col("y") / PARTNERS))
    groups = common.stored(met.select("x", "chunk").distinct())
    held = sequence.select("rank", "size", "ids", "copies", "data")
    columns = ["x", "chunk", "own", "y", "size", "ids", "copies", "data"]
    first = groups.join(held.withColumnRenamed("rank", "x"), "x").withColumns({"own": F.lit(True), "y": F.lit(-1).cast("long")}).select(columns)
    others = met.join(held.withColumnRenamed("rank", "y"), "y").withColumn("own", F.lit(False)).select(columns)
    rows = first.unionByName(others).repartition(max(1, min(groups.count(), 10_000)), "x", "chunk").sortWithinPartitions("x", "chunk", F.desc("own"), "y")
    with common.few_rows(sequence.sparkSession, 4):
        return common.stored(rows.mapInArrow(common.released(compare), "a long, b long, n long"))


def near_duplicates(table: DataFrame, least: float = 0.9, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of table(vec_id, embedding): other rows within a cosine of `least` (over 0), the least vec_id that links reach, and whether it is the row's own."""
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    rows, epsilon = marked(table), max(math.sqrt(2 - 2 * least), 1e-6)
    classes = common.stored(rows.where("key is not null").groupBy("size", "key", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")))
    basis = axes(classes)
    sequence = blocks(classes, basis, epsilon, block)
    found = links(sequence, block_pairs(sequence, epsilon), basis, least)
    roots = components.label(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    members = sequence.select(F.explode(F.arrays_zip("ids", "keys", "first", "copies")).alias("c")).select(F.col("c.ids").alias("id"), F.col("c.keys").alias("key"), F.col("c.first").alias("first"), F.col("c.copies").alias("copies"))
    rooted = members.join(roots.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").join(counts, "id", "left")
    rooted = common.stored(rooted.select("key", "first", F.coalesce("root", "id").alias("root"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least_of = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = common.stored(rooted.join(least_of, "root").select("key", "n_links", "component_id"))
    every = rows.select("vec_id", "key").join(known, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return every.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
