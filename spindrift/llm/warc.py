"""WARC archives in which later copies of a payload are revisit records.

Only headers (page, payload digest, size) are shuffled by digest; the largest page_id of each digest comes from a pre-aggregated maximum, so a payload that a third of all pages share costs no task more than its share. Revisits, with what they refer to, are joined back to the pages by page_id, broadcast where they are counted to be few. Each record is a gzip member of its own, as the format has it, so it can be read by its place in the file alone. Spark's text sink writes the members, one to a row, through its commit protocol, with an empty member between them; its reader splits the files, of any size, at the empty members, so a task holds one record at a time. An empty member holds bytes that no compressed data of UTF-8 text is likely to hold, and each record's checksums and length are verified. The sink names the files part-*.txt, though they are gzip.

Defined results: null html is an empty payload; a null url leaves its field out; a null page_id is never referred to unless no other page has its payload; payloads of fewer than min_bytes bytes are all responses; rows that repeat both the page_id and the payload of a response are responses too; an empty table gives no rows; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fields of the format, fixed values.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

END = b"\r\n\r\n"
#: A gzip member of no bytes, which stands between records.
EMPTY = zlib.compressobj(9, zlib.DEFLATED, 31).flush()
#: Rows of revisits that may be broadcast; more are joined by a shuffle.
FEW = 100_000
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{payload_digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, revisit: bool, date: str) -> bytes:
    """A record without the two line ends after it."""
    name = digest(payload)
    head = HTTP + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, name)), ("WARC-Date", date), ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha1:{name}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, name)), ("WARC-Refers-To-Target-URI", _clean(refers_url)), ("X-Refers-To-Page-ID", str(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    return f"{VERSION}\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode() + b"\r\n" + block


def _clean(url: str | None) -> str | None:
    return None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url)


#: Makes Spark's text source and sink end each row with an empty member.
BETWEEN = {"encoding": "ISO-8859-1", "lineSep": EMPTY.decode("latin-1")}


def member(made: bytes) -> bytes:
    """A record and the two line ends after it as a gzip member."""
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(made + END) + press.flush()


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record of an archive, compressed or not."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data:
            press = zlib.decompressobj(31)
            parts.append(press.decompress(data) + press.flush())
            if not press.eof:
                raise ValueError("a member has no end")
            data = press.unused_data
        data = b"".join(parts)
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at {at}")
        end = data.index(END, at)
        fields = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        start, size = end + 4, int(fields["Content-Length"])
        if data[start + size : start + size + 4] != END:
            raise ValueError(f"the record at {at} has no end")
        yield fields, data[start : start + size]
        at = start + size + 4


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The revisits among pages(page_id, url, html): (page_id, digest, refers_to, refers_url), stored."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    headers = pages.select("page_id", "url", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes")).where(F.col("bytes") >= min_bytes)
    known = headers.select("page_id", "digest", F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")).alias("one"))
    first = known.groupBy("digest").agg(F.max("one").alias("to"), F.count("*").alias("n")).where("n > 1 and to is not null").select("digest", "to")
    return common.stored(headers.select("page_id", "digest").join(common.stored(first), "digest").where("page_id is null or page_id < to.page_id").select("page_id", "digest", F.col("to.page_id").alias("refers_to"), F.col("to.url").alias("refers_url")).distinct())


def write(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes the archives of pages(page_id, url, html) to folder."""
    spark = pages.sparkSession
    common.short_batches(spark)
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    revisits = resolve(pages, min_bytes)
    revisits = revisits.select(F.col("page_id").alias("of"), F.col("digest").alias("copy"), "refers_to", "refers_url", F.lit(True).alias("revisit"))
    if revisits.count() <= FEW:
        revisits = F.broadcast(revisits)
    sha1 = F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    joined = pages.join(revisits, F.col("page_id").eqNullSafe(F.col("of")) & (sha1 == F.col("copy")), "left").select("page_id", "url", "html", "refers_to", "refers_url", F.coalesce("revisit", F.lit(False)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [member(record(page, url, (html or "").encode("utf-8", "surrogatepass"), to, to_url, revisit, date)) for page, url, html, to, to_url, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])

    joined.mapInArrow(rows, "value binary").select(F.col("value").cast("string")).write.options(**BETWEEN).text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives; size and digest of a response come from the payload itself, those of a revisit from its fields."""

    common.short_batches(spark)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for data in b.column(0):
                for fields, block in parse(data.as_py()):
                    head, payload = block.split(END, 1)
                    kind, to = fields["WARC-Type"], fields.get("X-Refers-To-Page-ID")
                    size = int(head.rpartition(b"Content-Length: ")[2])
                    name = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (size, name) != (len(payload), digest(payload)):
                        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
                    page = fields.get("X-Page-ID")
                    for column, x in zip(out, (None if page is None else int(page), size, name, kind, None if to is None else int(to)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return spark.read.options(**BETWEEN).text(folder).select(F.col("value").cast("binary").alias("record")).mapInArrow(rows, READ)


def round_trip(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes the archives below the shared folder (or in folder) and reads all records back."""
    spark = pages.sparkSession
    folder = folder or common.new_folder(spark, "warc")
    write(pages, folder, min_bytes)
    return read(spark, folder)
