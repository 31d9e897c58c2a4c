"""WARC archives: written with revisit records, read back in sequence.

Pages with equal payloads of at least ``MIN_PAYLOAD`` bytes are written once, as the
response of the largest id; the others become revisit records that name it.  Each
partition becomes one archive of one gzip member per record.  Spark's own text
writer puts the bytes into the folder, so archives reach any file system that Spark
writes to, and a lost or repeated task leaves no half archive.

The writer ends each row with a line separator.  It is set to NUL, and each row
holds the rest of one member and the start of the next up to its file name, which a
NUL ends by the format.  One NUL is left after the last member, as padding that
gzip readers skip.

The reader inflates a member piece by piece, takes the header up to the blank line,
frames the block by Content-Length and checks block and payload digests.

Defined cases: a null payload is an empty one; rows that share the largest id of equal payloads
are all responses; a null id ranks below all others and comes back as null; an empty table writes no
archive and gives an empty result.  Only the id, the address and the payload are read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import slices

MIN_PAYLOAD = 1000
LEVEL = 6
#: Bytes handed to the inflater at once.
PIECE = 1 << 16
#: The date of all records, unless the caller has one.
DATE = "1970-01-01T00:00:00Z"

_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "urn:page:"
_END = b"\r\n\r\n"


def digest_of(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def hex_digest(named: str) -> str:
    """The hex digits of a digest as records name it."""
    return base64.b32decode(named.partition(":")[2]).hex()


def identity(page: str | None) -> str:
    return f"<{_PAGE}{quote(page, safe='') if page is not None else ''}>"


def page_of(record_id: str) -> str | None:
    return unquote(record_id.strip("<>").removeprefix(_PAGE)) or None


def record(page: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str = DATE) -> tuple[str, bytes]:
    """The record's id and its bytes; a revisit if ``refers_to`` names a page."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", identity(page)),
        ("WARC-Date", date),
        ("WARC-Target-URI", "".join((url or "").split())),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", digest_of(payload)),
        ("WARC-Block-Digest", digest_of(block)),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", identity(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return identity(page), head.encode() + block + _END


def member(name: str, data: bytes, level: int = LEVEL) -> tuple[bytes, bytes]:
    """A gzip member in two parts; a NUL belongs between them, where the name ends."""
    press = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = press.compress(data) + press.flush()
    start = b"\x1f\x8b\x08\x08" + struct.pack("<IBB", 0, 0, 255) + name.encode("ascii")
    return start, body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def plan(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(id, url, payload, refers_to) as strings and bytes; ``refers_to`` is null for responses."""
    rows = pages.select(
        F.col(key).alias("id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.when(F.octet_length("payload") >= MIN_PAYLOAD, F.sha1("payload")))
    # Counted partially before the shuffle; only payloads that occur again are joined.
    again = (
        rows.filter(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(F.max("id").alias("holder"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") > 1) & F.col("holder").isNotNull())
        .select("digest", "holder")
    )
    revisits = ~F.col("id").eqNullSafe(F.col("holder")) & F.col("holder").isNotNull()
    return rows.join(again, "digest", "left").select(
        F.col("id").cast("string").alias("id"),
        "url",
        "payload",
        F.when(revisits, F.col("holder").cast("string")).alias("refers_to"),
    )


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = DATE) -> None:
    """Writes one archive per partition below ``path``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            for part in slices([batch], "payload"):
                out = []
                for row in part.to_pylist():
                    start, rest = member(*record(row["id"], row["url"], row["payload"], row["refers_to"], date))
                    out.append(start if left is None else left + start)
                    left = rest
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
        if left is not None:
            yield pa.RecordBatch.from_arrays([pa.array([left], pa.binary())], ["value"])

    packed = plan(pages, key, url, payload).mapInArrow(pack, "value binary")
    packed.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").text(path)


class Record(NamedTuple):
    offset: int
    fields: dict[str, str]
    block: bytes


def members(data: memoryview | bytes) -> Iterator[tuple[int, Iterator[bytes]]]:
    """(offset, pieces) of each gzip member; each must be used up before the next."""
    data, at = memoryview(data), 0
    while at < len(data):
        if data[at] == 0:  # padding
            at += 1
            continue
        start, inflate, ended = at, zlib.decompressobj(zlib.MAX_WBITS | 16), []

        def pieces() -> Iterator[bytes]:
            nonlocal at
            while not inflate.eof:
                if at >= len(data):
                    raise EOFError(f"the member at {start} is cut off")
                piece = data[at : at + PIECE]
                out = inflate.decompress(piece)
                at += len(piece) - len(inflate.unused_data)
                if out:
                    yield out
            ended.append(True)

        yield start, pieces()
        if not ended:
            raise ValueError("a member was left before its end")


def read_record(offset: int, pieces: Iterator[bytes]) -> Record:
    """Frames one record and checks its digests."""
    head = bytearray()
    for piece in pieces:
        head += piece
        if _END in head:
            break
    else:
        raise ValueError(f"no record header at {offset}")
    text, _, rest = bytes(head).partition(_END)
    version, *lines = text.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record at {offset}: {version[:20]!r}")
    fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    length = int(fields["content-length"])
    body = bytearray(rest)
    for piece in pieces:
        body += piece
    if len(body) != length + len(_END) or body[length:] != _END:
        raise ValueError(f"the record at {offset} has not the length it names")
    block = bytes(body[:length])
    if "warc-block-digest" in fields and digest_of(block) != fields["warc-block-digest"]:
        raise ValueError(f"the block at {offset} does not match its digest")
    return Record(offset, fields, block)


def _read(data) -> Iterator[tuple]:
    for offset, pieces in members(data):
        found = read_record(offset, pieces)
        http, _, payload = found.block.partition(_END)
        fields, revisit = found.fields, found.fields["warc-type"] == "revisit"
        sizes = [line.partition(b":")[2] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        size = int(sizes[0]) if revisit and sizes else len(payload)
        if not revisit and "warc-payload-digest" in fields and digest_of(payload) != fields["warc-payload-digest"]:
            raise ValueError(f"the payload at {offset} does not match its digest")
        refers_to = fields.get("warc-refers-to")
        yield (
            offset,
            page_of(fields["warc-record-id"]),
            fields["warc-type"],
            fields.get("warc-target-uri"),
            None if revisit else payload,
            size,
            hex_digest(fields["warc-payload-digest"]),
            page_of(refers_to) if refers_to else None,
        )


_RECORDS = pa.schema(
    [
        ("archive", pa.string()),
        ("offset", pa.int64()),
        ("page", pa.string()),
        ("record_type", pa.string()),
        ("url", pa.string()),
        ("payload", pa.binary()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.string()),
    ]
)
#: Payload bytes handed back to Spark at once.
_BATCH = 8 << 20


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``; a revisit's payload is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                rows, size = [], 0
                for row in _read(content.as_buffer()):
                    rows.append((name.as_py(), *row))
                    size += row[5]
                    if size >= _BATCH or len(rows) >= 4096:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kinds = {"int64": "bigint", "string": "string", "binary": "binary"}
    return files.mapInArrow(run, ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in _RECORDS))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORDS)], schema=_RECORDS)
