"""The prefix trie of conversations: which share their first turns, and what a cache of shared prefixes saves.

A turn is digested by itself (SHA-256 of role and text), before anything is shuffled, so texts stay where they are. The digests of a conversation, in order, are chained: the digest of a prefix is SHA-256 of the prefix before it and the turn, so equal digests of a depth are equal prefixes. Every prefix is exploded with its conversation; prefixes grouped by (depth, digest) are the nodes, counted before they are shuffled, so a prefix that a third of all conversations share is no hot group.

Subtree sums: each node belongs to one leaf below it, the one of the least conversation, and each leaf is exploded to all its ancestors with what belongs to it. A leaf's nodes are the last of its path; those above them get their sum, those among them a running sum. So a conversation of n turns makes n rows, where n nodes exploded one by one would make n squared.

The digest of a node's ends goes over the ids in order: ids are dealt by ranges of (node, id) and joined to blocks in each range, and only the blocks of a node meet, in one task that reads them one after another; of many ids no task holds more than a block.

Chaining is sequential by its nature, so a conversation is one task's, a digest and a length for each turn, and a batch in memory at a time.

Defined results: rows without conv_id take no part; a null turn comes first, turns of one number come in the order of their digests; null role or text is empty; repeated rows are turns each; conversations of any length are chained whole; an empty table has no conversations and gives no rows, not even the root; columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import scan
from . import common

#: Digest of the textless root.
ROOT = hashlib.sha256(b"").digest()
PREFIXES = "conv_id long, depth long, digest binary, parent binary, chars long, ended boolean"
#: Ids that are joined to one block before they meet the others of their node.
BLOCK_IDS = 4096


def turns(convs: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, chars) of every turn; the length of the role goes into the digest, so it shows where the text starts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    return convs.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), digest.alias("digest"), F.length(text).cast("long").alias("chars")).where("conv_id is not null")


def rebuilt(own: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Turns in which conversation c starts with the first h turns of conversation c - c % every (fewer if it has fewer) and goes on with its own after the first h; h is crc32(c) % most. (conv_id, part, turn, digest, chars, skip): part 0 are turns of the other conversation, skip is h; a conversation that has turns before has a row here."""
    h = F.crc32(F.col("conv_id").cast("string")) % most
    first = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    heads = own.where(F.col("conv_id") % every == 0).withColumn("at", F.row_number().over(first).cast("long")).where(F.col("at") < most)
    heads = heads.select(F.col("conv_id").alias("base"), "at", "digest", "chars")
    asked = own.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("skip"))
    given = asked.join(heads, (asked.base == heads.base) & (heads["at"] <= asked.skip))
    columns = ["conv_id", "part", "turn", "digest", "chars", "skip"]
    given = given.select("conv_id", F.lit(0).alias("part"), F.col("at").alias("turn"), "digest", "chars", "skip")
    return own.select("conv_id", F.lit(1).alias("part"), "turn", "digest", "chars", h.alias("skip")).unionByName(given).select(columns)


def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes of rows (conv_id, part, digest, chars, skip), conversation by conversation in order; the first `skip` rows of part 1 are left out."""
    names = [x.split()[0] for x in PREFIXES.split(", ")]
    out: list[list] = [[] for _ in names]
    now, digest, depth, left = None, ROOT, 0, 0

    def put(*row) -> None:
        for column, x in zip(out, row, strict=True):
            column.append(x)

    def made() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
        batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)
        for column in out:
            column.clear()
        return batch

    held = None  # the last prefix, until it is known whether its conversation goes on
    for b in batches:
        for conv, part, turn, chars, skip in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "digest", "chars", "skip")), strict=True):
            if conv != now:
                if held:
                    put(*held, True)
                now, digest, depth, left = conv, ROOT, 0, skip
                held = (conv, 0, ROOT, None, 0)
            if part and left:
                left -= 1
                continue
            put(*held, False)
            parent, digest, depth = digest, hashlib.sha256(digest + turn).digest(), depth + 1
            held = (conv, depth, digest, parent, chars)
        yield made()
    if held:
        put(*held, True)
        yield made()


def prefixes(rows: DataFrame) -> DataFrame:
    """Every prefix of every conversation of rows(conv_id, part, turn, digest, chars, skip), the empty one included: conv_id, depth, digest, parent (the digest one turn shorter, null at the root), chars of its last turn, ended (whether the conversation ends there)."""
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", F.asc_nulls_first("turn"), "digest")
    return ordered.select("conv_id", "part", "digest", "chars", "skip").mapInArrow(chain, PREFIXES)


def end_digests(ends: DataFrame, block: int = BLOCK_IDS) -> DataFrame:
    """(digest, ends_sha256) of ends(digest, conv_id): SHA-256 of a node's ids in decimal, ascending, comma-joined."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(map(str, ids))])], ["digest", "first", "ids"])
            ids.clear()
            return batch

        now, first, ids = None, 0, []
        for b in batches:
            for digest, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ids and (digest != now or len(ids) >= block):
                    yield made()
                if not ids:
                    now, first = digest, conv
                ids.append(conv)
        if ids:
            yield made()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            out: tuple[list, list] = ([], [])
            for digest, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if digest == now:
                    state.update(b",")
                else:
                    if state:
                        out[0].append(now)
                        out[1].append(state.hexdigest())
                    now, state = digest, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], ["digest", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["digest", "ends_sha256"])

    dealt = ends.select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    blocks = dealt.mapInArrow(joined, "digest binary, first long, ids string")
    return blocks.repartition("digest").sortWithinPartitions("digest", "first").select("digest", "ids").mapInArrow(hashed, "digest binary, ends_sha256 string")


def trie(found: DataFrame) -> DataFrame:
    """The nodes of stored prefixes: digest, depth, conv_id (the least member), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    grouped = found.groupBy("depth", "digest", "parent", "chars").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    nodes = common.stored(grouped)
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    nodes = common.stored(nodes.join(children, "digest", "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "weight": (F.col("n_convs") - 1) * F.col("chars")}))
    leaves = nodes.where("n_children = 0").select("conv_id")  # the members of a leaf are alike, so one path stands for them
    paths = common.stored(found.select("conv_id", "depth", "digest").join(leaves, "conv_id", "left_semi"))
    below = paths.groupBy("digest").agg(F.count("*").alias("n_leaves"), F.min("conv_id").alias("owner"))
    owned = common.stored(nodes.join(below, "digest"))
    top = owned.groupBy("owner").agg(F.min("depth").alias("top"), F.sum("weight").alias("all"))
    top = top.where(F.col("all") > 0).withColumnRenamed("owner", "conv_id")
    above = paths.join(top, "conv_id").where(F.col("depth") < F.col("top")).groupBy("digest").agg(F.sum("all").alias("others"))
    owned = scan.running(owned, ["owner"], [F.desc("depth")], {"saved": F.col("weight")})
    ends = end_digests(found.where("ended"))
    parents = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    full = owned.join(above, "digest", "left").join(ends, "digest", "left").join(parents, "parent", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return full.select("digest", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("saved") + F.coalesce("others", F.lit(0))).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))


def rebuilt_trie(convs: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """The trie of the rebuilt conversations of a table."""
    found = common.stored(prefixes(rebuilt(turns(convs), every, most)))
    return trie(found).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
