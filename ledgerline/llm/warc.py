"""WARC archives whose records are compressed one by one with a dictionary trained on the archive itself.

A file starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, compressed; after it every record is a Zstandard frame of its own.
Payloads that repeat are stored once: the record with the largest page_id is the response, the others revisit it.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, dealt, shared_dir, stored
from .files import Saved, content

#: Fixed by the format: magic of the dictionary frame.
DICTIONARY_MAGIC = 0x184D2A5D
#: The least payload that is revisited; records and bytes of each that train a dictionary; its size; bytes of records in a file before the next one starts.
LEAST, SAMPLES, SAMPLE_BYTES, DICTIONARY, FILE_BYTES = 1000, 400, 16_384, 64 << 10, 64 << 20
VERSION = "WARC/1.1"


def record(page: int, url: str | None, payload: bytes, digest: str, refers: int | None, refers_url: str | None = None) -> bytes:
    """One record: headers, an empty line, the block, two empty lines."""
    safe = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [VERSION, f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    block = payload
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
        block = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record has another length than it says")
    return fields, rest[:size]


def trained(records: list[bytes]) -> bytes:
    """A dictionary from the records at hand; where they are too few or too alike to train one, their beginnings are the dictionary themselves."""
    parts = [r[:SAMPLE_BYTES] for r in records]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY:]


def write_archives(folder: str):
    """Rows (page_id, url, payload, digest, refers_to) -> a row for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[bytes] = []
        file, press, count = None, None, 0

        def start() -> None:
            nonlocal file, press, count
            own = trained(waiting)
            file, count = Saved(folder, ".warc.zst"), 0
            frame = zstandard.ZstdCompressor(level=3).compress(own)
            file.write(struct.pack("<II", DICTIONARY_MAGIC, len(frame)) + frame)
            press = zstandard.ZstdCompressor(level=3, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(own))
            for r in waiting:
                file.write(press.compress(r))
            count += len(waiting)
            waiting.clear()

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"path": file.close(), "records": count, "bytes": file.size}], schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for page, url, payload, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                r = record(page, url, payload, digest, refers)
                if file is None:
                    waiting.append(r)
                    if len(waiting) >= SAMPLES or sum(map(len, waiting[-1:])) > SAMPLE_BYTES * SAMPLES:
                        start()
                    continue
                file.write(press.compress(r))
                count += 1
                if file.size >= FILE_BYTES:
                    yield row()
                    file = None
        if file is None and waiting:
            start()
        if file is not None:
            yield row()

    return run


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive's bytes, in order."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive has no dictionary frame")
    own = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    opener, rest = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(own)), memoryview(data)[8 + size :]
    while len(rest):
        one = opener.decompressobj()
        out = [one.decompress(rest)]
        yield b"".join(out)
        rest = rest[len(rest) - len(one.unused_data) :]


def read_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows = []
            for data in frames(content(path)):
                h, block = parsed(data)
                kind, digest = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and hashlib.sha1(block).hexdigest() != digest:
                    raise ValueError("a payload has another digest than its record says")
                number = lambda x: int(x[len("<urn:page:") : -1])
                rows.append({"page_id": number(h["WARC-Record-ID"]), "payload_bytes": int(h["X-Payload-Length"]), "payload_digest": digest, "record_type": kind, "refers_to": number(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))


def write_pages(pages: DataFrame) -> DataFrame:
    """Archive every row of pages (page_id, url, html); returns the stored manifest (path, records, bytes).

    A null html is an empty payload. Rows without page_id are dropped; rows that repeat a page_id are each archived, and of equal payloads of the largest page_id all are responses.
    Extra columns are ignored. An empty table writes no archive."""
    spark = pages.sparkSession
    p = pages.select(column(pages, "page_id", "bigint").alias("page_id"), column(pages, "url", "string").alias("url"), F.coalesce(column(pages, "html", "string"), F.lit("")).cast("binary").alias("payload")).filter("page_id IS NOT NULL").withColumn("digest", F.sha1("payload"))
    # who refers to whom is settled on narrow rows; payloads move by page and digest, so a payload that very many pages share is no hot key
    narrow = p.filter(F.length("payload") >= LEAST).select("page_id", "digest")
    large = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).filter("least < refers_to").select("digest", "refers_to")
    refers = narrow.distinct().join(large, "digest").filter("page_id <> refers_to")
    known = p.join(refers, ["page_id", "digest"], "left")
    return stored(known.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write_archives(shared_dir(spark, "warc")), "path string, records bigint, bytes bigint"), "manifest")


def read_pages(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all records in the archives of a manifest."""
    return dealt(manifest.select("path")).mapInArrow(read_archives, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
