"""Zstandard web archives: writing pages as WARC records and reading archives back.

An archive starts with a skippable frame that holds its compression dictionary, followed by one
frame for each record. Records with equal payloads are written once: the others are revisits, which
carry the headers and the digest but no payload.

Archives are cells of a binary column, so that Spark's own writers and readers move them through any
store; ``read_files`` reads archive files the same way. The reader decodes record by record.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrain.llm.frames import map_batches, stored

#: Fixed values of the formats: magic of a dictionary frame, version line, profile of revisits.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads shorter than this are never replaced by a revisit.
LEAST_SHARED = 100
#: Uncompressed bytes after which an archive is closed, and the size and samples of its dictionary.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES = 4 << 20, 16 << 10, 1 << 20
#: Bytes fed to the decoder at a time.
STEP = 1 << 16


class BrokenArchive(ValueError):
    """An archive whose frames, headers, lengths or digests don't fit together."""


@dataclass
class Record:
    """One record as read: headers by lower-case name, and the block."""

    headers: dict[str, str]
    block: bytes


def make_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """Bytes of a record; Content-Length and the block's digest are added."""
    lines = [VERSION]
    digest = hashlib.sha256(block).hexdigest()
    for name, value in [*headers, ("WARC-Block-Digest", f"sha256:{digest}"), ("Content-Length", str(len(block)))]:
        clean = value.replace("\r", "%0D").replace("\n", "%0A")
        lines.append(f"{name}: {clean}".encode())
    return b"\r\n".join([*lines, b"", block, b"", b""])


def parse_record(data: bytes) -> Record:
    """Checks version, headers, length, closing lines and digest of a record's bytes."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or version != VERSION:
        raise BrokenArchive(f"a record starts with {version[:20]!r}")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name.strip() or name != name.strip():
            raise BrokenArchive(f"not a header: {line[:60]!r}")
        if name.lower() in headers:
            raise BrokenArchive(f"header {name} is repeated")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise BrokenArchive(f"header {name} is missing")
    if not headers["content-length"].isdecimal():
        raise BrokenArchive("Content-Length is not a number")
    length = int(headers["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise BrokenArchive(f"Content-Length is {length}, the record has {len(rest) - 4} bytes")
    digest = headers.get("warc-block-digest")
    if digest and digest != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise BrokenArchive("the block does not have its digest")
    return Record(headers, block)


def _dictionary(records: list[bytes]) -> bytes:
    """A dictionary trained on the start of the records; empty where there is too little to learn from."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r[:8192] for r in records]).as_bytes()
    except zstandard.ZstdError:
        return b""


def make_archive(records: list[bytes], level: int = 3) -> bytes:
    """An archive of records: dictionary frame, then a frame for each record."""
    taken, size = [], 0
    for record in records:
        if size >= SAMPLE_BYTES:
            break
        taken.append(record)
        size += min(len(record), 8192)
    dictionary = _dictionary(taken)
    kind = zstandard.DICT_TYPE_FULLDICT if dictionary else zstandard.DICT_TYPE_RAWCONTENT
    compressor = zstandard.ZstdCompressor(
        level=level, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=kind), write_checksum=True
    )
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary + b"".join(map(compressor.compress, records))


def read_archive(data: bytes) -> Iterator[Record]:
    """The records of an archive, one frame at a time."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        raise BrokenArchive("no dictionary frame at the start")
    size = struct.unpack_from("<I", data, 4)[0]
    if len(data) < 8 + size:
        raise BrokenArchive("the dictionary frame is cut off")
    dictionary = data[8 : 8 + size]
    if dictionary[:4] == b"\x28\xb5\x2f\xfd":  # a dictionary may itself be compressed
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    kind = zstandard.DICT_TYPE_FULLDICT if dictionary else zstandard.DICT_TYPE_RAWCONTENT
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=kind))
    at, view = 8 + size, memoryview(data)
    while at < len(data):
        frame, parts = decoder.decompressobj(), []
        try:
            while not frame.eof:
                if at >= len(data):
                    raise BrokenArchive("the last frame is cut off")
                step = view[at : at + STEP]
                parts.append(frame.decompress(step))
                at += len(step) - len(frame.unused_data)
        except zstandard.ZstdError as error:
            raise BrokenArchive(f"a frame can't be decoded: {error}") from error
        yield parse_record(b"".join(parts))


def page_id_of(urn: str | None) -> int | None:
    """The page id in a record's name."""
    number = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdecimal() else None


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """The record of a page: a response, or a revisit of page ``first`` where that is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = "none" if page_id is None else page_id
    headers = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", f"<urn:x-page:{name}>")]
    headers += [("WARC-Date", date), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        headers.append(("WARC-Target-URI", url))
    headers.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if first is None:
        return make_record(headers, http + payload)
    return make_record([*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{first}>")], http)


def write_archives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archives of ``pages`` (page_id, url, html), one in each row's ``content``.

    A null html is an empty payload. Among equal payloads of ``LEAST_SHARED`` bytes or more the
    smallest page_id is the response; repeated rows of that page are responses as well. A page
    without an id is never the one revisited, and where no page of a payload has an id all are
    responses. Other columns are left out.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    # One narrow row for each payload that occurs again; copies are folded before the shuffle.
    firsts = (
        keyed.where(F.octet_length("payload") >= LEAST_SHARED)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    # A payload with a third of all rows leaves one row on the right, so its rows on the left can be split.
    planned = keyed.join(firsts, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first")
    )

    def archives(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[bytes] = []
        size = 0
        for part in parts:
            for row in part.to_pylist():
                waiting.append(page_record(row["page_id"], row["url"], row["payload"], row["digest"], row["first"], date))
                size += len(waiting[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_pydict({"content": [make_archive(waiting)]})
                    waiting, size = [], 0
        if waiting:
            yield pa.RecordBatch.from_pydict({"content": [make_archive(waiting)]})

    return map_batches(planned, archives, "content binary")


READ_SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archives(archives: DataFrame, content: str = "content") -> DataFrame:
    """The records in archives; a broken archive raises ``BrokenArchive`` in its task.

    The payload of a revisit is null: its length is in the repeated HTTP header and its digest in the
    record's header. An empty table of archives gives an empty table.
    """

    def records(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for archive in part.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist(list(map(_row, read_archive(archive))), schema=kinds)

    names = ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload")
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    kinds = pa.schema(list(zip(names, types, strict=True)))
    return map_batches(archives.select(content), records, READ_SCHEMA)


def _row(record: Record) -> dict[str, object]:
    headers = record.headers
    http, gap, payload = record.block.partition(b"\r\n\r\n")
    fields = dict(x.lower().split(b": ", 1) for x in http.split(b"\r\n")[1:])
    length = int(fields[b"content-length"])
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    revisit = headers["warc-type"] == "revisit"
    if not gap or (payload if revisit else len(payload) != length):
        raise BrokenArchive("the payload does not have its length")
    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
        raise BrokenArchive("the payload does not have its digest")
    return {
        "page_id": page_id_of(headers["warc-record-id"]), "url": headers.get("warc-target-uri"),
        "record_type": headers["warc-type"], "payload_bytes": length, "payload_digest": digest,
        "refers_to": page_id_of(headers.get("warc-refers-to")), "payload": None if revisit else payload,
    }


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of archive files below ``path``."""
    return read_archives(spark.read.format("binaryFile").load(path))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back, without the payloads."""
    archives = stored(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


OP5_SQL = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest,
         octet_length(encode(coalesce(html, ''))) AS n
  FROM pages
), f AS (
  SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest HAVING count(*) > 1
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, url
FROM p LEFT JOIN f ON p.digest = f.digest
"""
