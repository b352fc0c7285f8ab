"""WARC archives compressed record by record with a Zstandard dictionary.

Each archive holds, in order: a skippable frame (magic 0x184D2A5D) with a dictionary built from the archive's own
records, then one frame per record.  An archive is one binary row ``(archive, content)``, the shape of Spark's
``binaryFile`` source, so that Spark's writers store it on any file system and its commit protocol covers lost
executors; :func:`export_archives` also writes the same bytes as ``.warc.zst`` files.  Archives close at ``roll_bytes``
of raw records, which bounds a task's memory; the dictionary is trained on at most ``SAMPLE_BYTES`` of them.

Of records with equal payloads the one with the smallest id is a response, the others are revisits of it.  Edges:
null html is an empty payload; empty payloads are compared like all others; repeated ids stay separate records;
a null url gives an empty target; very long payloads make an archive of their own; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAGIC = 0x184D2A5D
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 16 << 10
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit carries no payload."""
    body = b"" if revisit else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def train(records: list[bytes]) -> bytes:
    """A dictionary from evenly spaced records; raw content of theirs where there is too little to train on."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    sample = [r[: 64 << 10] for r in records[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:DICTIONARY_BYTES].ljust(8, b"\0")


def pack(records: list[bytes], level: int) -> bytes:
    content = train(records)
    dictionary = zstandard.ZstdCompressionDict(content)
    writer = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True)
    return b"".join([struct.pack("<II", MAGIC, len(content)), content, *map(writer.compress, records)])


def unpack(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    magic, size = struct.unpack_from("<II", archive)
    if magic != MAGIC:
        raise ValueError("no dictionary frame at the start of the archive")
    view = memoryview(archive)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[8 : 8 + size])))
    at = 8 + size
    while at < len(view):
        one, record = reader.decompressobj(), []
        while not one.eof:
            if at >= len(view):
                raise ValueError("the archive ends inside a record")
            record.append(one.decompress(view[at : at + 32768]))
            at = min(len(view), at + 32768)
        at -= len(one.unused_data)
        yield b"".join(record)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def write_archives(pages: DataFrame, roll_bytes: int = 8 << 20, level: int = 6) -> DataFrame:
    """Archives ``(archive string, content binary)`` of ``pages(page_id, url, html)``; rows without an id are responses."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    first = rows.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    # the roles of repeated payloads only: ids and digests, so that the texts move once at most
    roles = rows.select("sha", "page_id").join(first, "sha").where("page_id > first_id").select("page_id", "sha", "first_id").distinct()
    rows = rows.join(roles, ["page_id", "sha"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, part = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{part:05d}.warc.zst"]), pa.array([pack(held, level)], pa.binary())], ["archive", "content"])

        for b in batches:
            for page_id, url, html, sha, first_id in zip(*(b[c].to_pylist() for c in ("page_id", "url", "html", "sha", "first_id")), strict=True):
                record = make_record(page_id, url or "", html.encode(), base64.b32encode(sha).decode(), first_id, first_id is not None)
                if held and size + len(record) > roll_bytes:
                    yield close()
                    held, size, part = [], 0, part + 1
                held.append(record)
                size += len(record)
        if held:
            yield close()

    return rows.mapInArrow(run, "archive string, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of ``archives(archive, content)``; digests of responses are checked against their payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b["content"]:
                rows: list[tuple] = []
                for record in unpack(content.as_buffer()):
                    fields, payload = parse_record(record)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and (payload_digest(payload) != digest or len(payload) != int(fields["X-Payload-Length"])):
                        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                    ids = [None if x in ("", "None") else int(x) for x in (fields[k][10:-1] if k in fields else "" for k in ("WARC-Record-ID", "WARC-Refers-To"))]
                    rows.append((ids[0], unquote(fields["WARC-Target-URI"]), int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], ids[1], payload.decode() if fields["WARC-Type"] == "response" else None))
                    if len(rows) == 256:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    types = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), types, strict=True)], [n for n, _ in types])

    return archives.select("archive", "content").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")


def export_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive as a file of ``folder``, which every executor must have mounted; returns ``(path, bytes)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            done = []
            for name, content in zip(b["archive"].to_pylist(), b["content"], strict=True):
                path = os.path.join(folder, name)
                with open(f"{path}.{os.getpid()}.tmp", "wb") as f:
                    f.write(content.as_buffer())
                os.replace(f.name, path)  # an attempt that is run again replaces the same file
                done.append((path, os.path.getsize(path)))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "bytes"])

    return archives.mapInArrow(run, "path string, bytes long")
