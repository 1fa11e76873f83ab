"""Token ids in bit-plane files.

A file holds the ids of neighbouring documents in ascending doc_id order. Every `block` ids are transposed into bit planes, as many as the largest id needs; each plane is compressed with zstandard. Layout, all integers little-endian:

* block: "BPLK", ids u32, planes u8, compressed size of each plane u32, the planes from the lowest bit, line feed;
* index, after the last block: "BPIX", compressed size u32, then with zstandard: blocks u32, documents u32, offset of each block u64, ids in each block u32, doc_id of each document i64, null flag of each u8, ids of each u64; line feed;
* tail: "BPND", offset of the index u64, line feed.

Documents are encoded where they lie; their ids, two bytes each where the vocabulary allows it, go to ranges of (doc_id, hash of the text), so rows that repeat a doc_id, or have none, are spread too. The bounds of the ranges come from a sample of these two columns, about a hundred rows for each range, so nothing is encoded twice or stored between. A range makes as many files as it takes: one is closed at the end of the document that fills it (`file_ids`), so a file stays small enough to be read as one value however large the corpus. A file is one row of Spark's text sink, which writes it as it is, ended by a line feed, and with one row to a file; so files go through Spark's commit protocol (safe if a task is lost or tried twice) to any store that Spark reaches. They follow one another by the two numbers in their names, of the range and within it.

Defined results: null text counts as empty, such a document has its end id alone; repeated rows are written each, those of one doc_id in the order of their texts' hashes; a null doc_id sorts first; an empty table gives no files and no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, common, tokens

BLOCK = 65536
#: Ids after which a file is closed; about 12 MB at 12 bits an id.
FILE_IDS = 8_000_000


def pack_block(ids: np.ndarray, level: int = 1) -> bytes:
    planes = max(1, int(ids.max()).bit_length())
    press = zstandard.ZstdCompressor(level=level)
    parts = [press.compress(np.packbits((ids >> k & 1).astype(np.uint8)).tobytes()) for k in range(planes)]
    return struct.pack(f"<4sIB{planes}I", b"BPLK", len(ids), planes, *map(len, parts)) + b"".join(parts)


def unpack_block(data: memoryview | bytes) -> np.ndarray:
    magic, n, planes = struct.unpack_from("<4sIB", data)
    if magic != b"BPLK":
        raise ValueError("not a block")
    sizes, at, press = struct.unpack_from(f"<{planes}I", data, 9), 9 + 4 * planes, zstandard.ZstdDecompressor()
    ids = np.zeros(n, np.uint32)
    for k, size in enumerate(sizes):
        bits = np.unpackbits(np.frombuffer(press.decompress(data[at : at + size]), np.uint8), count=n)
        ids |= bits.astype(np.uint32) << np.uint32(k)
        at += size
    return ids


def write_files(docs: Iterator[tuple[int | None, np.ndarray]], block: int = BLOCK, file_ids: int = FILE_IDS) -> Iterator[bytes]:
    """The files, without the last line feed, of (doc_id, ids); none if there are no documents."""
    file = _File(block)
    for doc_id, ids in docs:
        file.add(doc_id, ids)
        if file.ids >= file_ids:
            yield file.closed()
            file = _File(block)
    if file.names:
        yield file.closed()


class _File:
    """A file as it is written: compressed blocks, and the ids that don't fill one yet."""

    def __init__(self, block: int):
        self.block, self.ids, self.at, self.size = block, 0, 0, 0
        self.rows: list[bytes] = []
        self.held: list[np.ndarray] = []
        self.offsets, self.counts, self.names, self.nulls, self.lengths = [], [], [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        for column, x in ((self.names, doc_id or 0), (self.nulls, doc_id is None), (self.lengths, len(ids))):
            column.append(x)
        self.ids += len(ids)
        self.size += len(ids)
        self.held.append(ids)
        if self.size >= self.block:
            joined = np.concatenate(self.held)
            whole = self.size // self.block * self.block
            for k in range(0, whole, self.block):
                self._put(joined[k : k + self.block])
            self.held, self.size = [joined[whole:].copy()], self.size - whole

    def _put(self, ids: np.ndarray) -> None:
        row = pack_block(ids.astype(np.uint32))
        self.offsets.append(self.at)
        self.counts.append(len(ids))
        self.rows.append(row)
        self.at += len(row) + 1

    def closed(self) -> bytes:
        if self.size:
            self._put(np.concatenate(self.held))
        arrays = zip((self.offsets, self.counts, self.names, self.nulls, self.lengths), ("<u8", "<u4", "<i8", "u1", "<u8"), strict=True)
        index = struct.pack("<II", len(self.offsets), len(self.names)) + b"".join(np.array(x, kind).tobytes() for x, kind in arrays)
        index = zstandard.ZstdCompressor().compress(index)
        return b"\n".join([*self.rows, struct.pack("<4sI", b"BPIX", len(index)) + index, struct.pack("<4sQ", b"BPND", self.at)])


def read_index(data: bytes) -> tuple[np.ndarray, np.ndarray, list[int | None], np.ndarray]:
    """Offsets and sizes of blocks, ids and sizes of documents."""
    magic, at = struct.unpack_from("<4sQ", data, len(data) - 13)
    if magic != b"BPND" or data[at : at + 4] != b"BPIX":
        raise ValueError("not a bit-plane file")
    raw = zstandard.ZstdDecompressor().decompress(data[at + 8 : at + 8 + struct.unpack_from("<I", data, at + 4)[0]])
    blocks, documents = struct.unpack_from("<II", raw)
    place, out = 8, []
    for kind, n in (("<u8", blocks), ("<u4", blocks), ("<i8", documents), ("u1", documents), ("<u8", documents)):
        out.append(np.frombuffer(raw, kind, n, place))
        place += out[-1].nbytes
    return out[0], out[1], [None if null else int(x) for x, null in zip(out[2], out[3], strict=True)], out[4]


def read_docs(data: bytes) -> Iterator[tuple[int | None, int, bytes]]:
    """(doc_id, first id's place in the file, ids as uint32 bytes) of a file, a few blocks in memory at a time."""
    offsets, _, names, lengths = read_index(data)
    view, held, first, nxt, place = memoryview(data), np.zeros(0, np.uint32), 0, 0, 0
    for doc_id, n in zip(names, map(int, lengths), strict=True):
        while first + len(held) < place + n:
            held = np.concatenate([held[place - first :], unpack_block(view[int(offsets[nxt]) :])])
            first, nxt = place, nxt + 1
        yield doc_id, place, held[place - first : place - first + n].astype("<u4").tobytes()
        place += n


def bounds(docs: DataFrame, ranges: int, each: int = 100) -> list[tuple[bool, int, int]]:
    """(doc_id is there, doc_id, hash of the text) where the second and later of about `ranges` ranges of about equal rows start, from about `each` rows for each range."""
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_hash().alias("mixed"))
    n = keys.count()
    sample = sorted(_place(*r) for r in keys.where(common.hash_share(ranges * each, n, F.col("doc_id"), F.col("mixed"))).collect())
    return sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []


def _place(doc_id: int | None, mixed: int) -> tuple[bool, int, int]:
    return doc_id is not None, doc_id or 0, mixed


def write(docs: DataFrame, folder: str, tokenizer_path: str | None = None, end_id: int = 1, block: int = BLOCK, file_ids: int = FILE_IDS) -> None:
    """Encodes docs(doc_id, text), each followed by end_id, into bit-plane files in folder, in ascending doc_id order over all files."""
    spark, path = docs.sparkSession, tokenizer_path or tokens.public_path("word_bpe_49k.json")
    common.short_batches(spark)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    starts = bounds(docs, ranges)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.codec(path)
        for b in batches:
            found = [np.append(tokens.ids_of(x), np.uint32(end_id)) for x in codec.encode_column(b.column(2))]
            wide = [bool((x >> 16).any()) for x in found]
            ids = [x.astype("<u4" if w else "<u2").tobytes() for x, w in zip(found, wide, strict=True)]
            of = [bisect_right(starts, _place(*key)) for key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(of, pa.int32()), pa.array(wide), pa.array(ids, pa.binary())], ["doc_id", "mixed", "range", "wide", "ids"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((doc_id, np.frombuffer(ids, "<u4" if wide else "<u2")) for b in batches for doc_id, wide, ids in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for file in write_files(found, block, file_ids):
            yield pa.RecordBatch.from_arrays([pa.array([file], pa.binary())], ["value"])

    texts = docs.select(F.col("doc_id").cast("long"), common.text_hash().alias("mixed"), F.col("text").cast("string").alias("text"))
    encoded = texts.mapInArrow(common.released(encode), "doc_id long, mixed long, range int, wide boolean, ids binary")
    ordered = encoded.repartitionById(ranges, "range").sortWithinPartitions("doc_id", "mixed").select("doc_id", "wide", "ids")
    files = ordered.mapInArrow(common.released(rows), "value binary")
    files.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids (uint32 bytes) and ids_crc32."""

    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = data.as_py()
                out: list[list] = [[], [], [], []]
                for doc_id, place, ids in read_docs(data) if data else ():
                    for column, x in zip(out, (doc_id, place, len(ids) // 4, zlib.crc32(ids)), strict=True):
                        column.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(out[0])), *(pa.array(x, pa.int64()) for x in out)], ["file", "doc_id", "place", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("path", "content")
    found = common.stored(files.mapInArrow(common.released(docs), "file string, doc_id long, place long, n_tokens long, ids_crc32 long"))
    named = found.groupBy("file").agg(F.sum("n_tokens").alias("total")).select("file", "total", *[F.regexp_extract("file", p, 1).cast("long").alias(n) for n, p in (("range", r"part-(\d+)-[^/]*$"), ("nth", r"-c(\d+)\.[^/]*$"))])
    upto = lambda w: F.coalesce(F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = named.groupBy("range").agg(F.sum("total").alias("total")).select("range", upto(Window.orderBy("range")).alias("first"))  # a row for each range
    before = named.withColumn("within", upto(Window.partitionBy("range").orderBy("nth"))).join(ranges, "range").select("file", (F.col("first") + F.col("within")).alias("before"))
    return found.join(before, "file").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1, block: int = BLOCK, folder: str | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files below the shared folder (or in folder) and reads the documents back from them."""
    spark = docs.sparkSession
    folder = folder or common.new_folder(spark, "planes")
    write(docs, folder, tokenizer_path, end_id, block, file_ids)
    return read(spark, folder)
