"""WARC archives compressed with a dictionary, written and read on the executors.

Each task streams its records.  The first ``SAMPLE_BYTES`` of them train a
Zstandard dictionary; it leads the file in a skippable frame, and every record
is a frame of its own compressed with it.  A file is closed beyond
``ROLL_BYTES``, and the next one trains anew.  File names carry the task
attempt, and the returned manifest lists the files of successful attempts only,
so a lost executor or a repeated attempt leaves no record twice or missing.

Records with one payload digest are written once: the one with the largest
page_id is a ``response``, the others are ``revisit`` records that name it.
Payloads shorter than ``revisit_from`` bytes are always responses.

A null payload is empty, a null url has no target header, a null page_id has no
record id and never is the one revisited.  Rows that repeat the largest page_id
of their digest are responses all.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm import common as C

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
DICTIONARY_MAGIC = 0xEC30A437
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

SAMPLE_BYTES = 1 << 21
DICTIONARY_BYTES = 1 << 15
ROLL_BYTES = 1 << 26
LEVEL = 3
URN = b"urn:x-page:"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column: five hex digits make four characters."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, scratch: C.Scratch, payload: str = "html", revisit_from: int = 0) -> DataFrame:
    """``page_id, url, payload, digest, n, refers_to``: what each record will be.

    Only digests that occur more than once are joined back, from a written
    table, so the join can be broadcast or split as its size demands.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("n", F.length("payload").cast("bigint"))
    again = scratch.write(rows.where(F.col("n") >= revisit_from).groupBy("digest")
                          .agg(F.max("page_id").alias("target"), F.count("*").alias("k"))
                          .where("k > 1 and target is not null").select("digest", "target"), "again")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("target"))
    refers = F.when((F.col("n") >= revisit_from) & other, F.col("target"))
    return rows.join(again, "digest", "left").select(
        "page_id", "url", "payload", "digest", "n", refers.alias("refers_to"))


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record."""
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit")]
    if page_id is not None:
        head.append(b"WARC-Record-ID: <" + URN + str(page_id).encode() + b">")
    if url is not None:
        head.append(b"WARC-Target-URI: " + url.encode().replace(b"\r", b"%0D").replace(b"\n", b"%0A"))
    head += [b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Payload-Digest: sha1:" + digest.encode(),
             b"Content-Type: application/http;msgtype=response"]
    block = HTTP_HEAD + b"Content-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    if refers_to is None:
        block += payload
    else:
        head += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: <" + URN + str(refers_to).encode() + b">"]
    head.append(b"Content-Length: " + str(len(block)).encode())
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; plain content if they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


class _Archive:
    """An open archive file: dictionary frame, then one frame a record."""

    def __init__(self, fs, path: str, first: list[bytes]):
        self.path, self.count = path, 0
        self.out = fs.open_output_stream(path)
        data = dictionary(first)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(data)) + data)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data))
        self.size = len(data) + 8
        for r in first:
            self.add(r)

    def add(self, data: bytes) -> None:
        frame = self.compressor.compress(data)
        self.out.write(frame)
        self.size += len(frame)
        self.count += 1


def _write(folder: str):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        done: list = []
        archive, held, weight = None, [], 0

        def open_archive():
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId():x}-{len(done):03d}.warc.zst"
            return _Archive(fs, f"{base}/{name}", held)

        def close(a):
            a.out.close()
            done.append((f"{folder}/{a.path.rsplit('/', 1)[1]}", a.count, a.size))

        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for i in range(batch.num_rows):
                data = record(*(c[i].as_py() for c in cols))
                if archive is None:
                    held.append(data)
                    weight += len(data)
                    if weight < SAMPLE_BYTES:
                        continue
                    archive, held, weight = open_archive(), [], 0
                else:
                    archive.add(data)
                if archive.size >= ROLL_BYTES:
                    close(archive)
                    archive = None
        if held:
            archive = open_archive()
        if archive is not None:
            close(archive)
        if done:
            path, n, size = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(n, pa.int64()), pa.array(size, pa.int64())],
                                             names=["path", "records", "bytes"])
    return fn


def write_archives(planned: DataFrame, folder: str, scratch: C.Scratch) -> DataFrame:
    """Write what :func:`plan_records` planned; returns ``path, records, bytes`` of each file."""
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    return scratch.write(planned.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(
        _write(folder), "path string, records bigint, bytes bigint"), "manifest")


def parse(stream) -> Iterator[tuple[dict, bytes]]:
    """Headers and block of each record of a decompressed stream."""
    buffer = b""

    def fill(n: int) -> bool:
        nonlocal buffer
        parts, have = [buffer], len(buffer)
        while have < n:
            more = stream.read(max(1 << 16, n - have))
            if not more:
                break
            parts.append(more)
            have += len(more)
        buffer = b"".join(parts)
        return have >= n

    while True:
        end = buffer.find(b"\r\n\r\n")
        while end < 0:
            if not fill(len(buffer) + 1):
                if buffer.strip():
                    raise ValueError("an archive ends inside a record")
                return
            end = buffer.find(b"\r\n\r\n")
        lines = buffer[:end].split(b"\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines[1:])}
        n = int(head[b"content-length"])
        if not fill(end + 4 + n + 4):
            raise ValueError("an archive ends inside a record")
        yield head, buffer[end + 4:end + 4 + n]
        buffer = buffer[end + 4 + n + 4:]


def open_archive(fs, path: str):
    """Decompressed stream of an archive, its dictionary taken from the leading frame."""
    raw = fs.open_input_stream(path)
    magic, size = struct.unpack("<II", raw.read(8))
    if magic != SKIPPABLE_MAGIC:
        raise ValueError(f"{path} does not start with a dictionary frame")
    data = zstandard.ZstdCompressionDict(raw.read(size))
    return zstandard.ZstdDecompressor(dict_data=data).stream_reader(raw, read_across_frames=True)


def _number(value: bytes | None):
    return None if value is None else int(value.strip(b"<>")[len(URN):])


def _read(with_payload: bool):
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(),
             "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, weight = [], 0

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))

        for batch in batches:
            for uri in batch.column("path").to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                for head, block in parse(open_archive(fs, path)):
                    kind = head[b"warc-type"].decode()
                    http, _, payload = block.partition(b"\r\n\r\n")
                    if kind == "response":
                        n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    else:
                        n = int(http.rpartition(b"Content-Length: ")[2])
                        digest = head[b"warc-payload-digest"].decode().removeprefix("sha1:")
                    url = head.get(b"warc-target-uri")
                    rows.append((_number(head.get(b"warc-record-id")), url and url.decode(),
                                 payload if with_payload and kind == "response" else None, n, digest, kind,
                                 _number(head.get(b"warc-refers-to"))))
                    weight += len(payload) if with_payload else 64
                    if weight >= 1 << 22:
                        yield batch_of(rows)
                        rows, weight = [], 0
        if rows:
            yield batch_of(rows)
    return fn


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the listed archives, a file streamed at a time.

    ``page_id, url, payload`` (of responses), ``payload_bytes, payload_digest``
    (of a response: of the payload as read), ``record_type, refers_to``.
    """
    files = max(1, manifest.count())
    return manifest.select("path").repartition(files).mapInArrow(
        _read(with_payload), "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, "
                             "record_type string, refers_to bigint")


def archive(pages: DataFrame, payload: str = "html", revisit_from: int = 0) -> DataFrame:
    """Write ``pages(page_id, url, payload)`` to archives in the shared folder; returns the manifest."""
    scratch = C.Scratch(pages.sparkSession, "warc")
    return write_archives(plan_records(pages, scratch, payload, revisit_from), scratch.path("archives"), scratch)
