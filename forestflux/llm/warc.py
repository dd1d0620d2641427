"""WARC archives with revisit resolution.

Headers (id, payload digest, length) are shuffled by digest without the payloads; of equal payloads of at least `least` bytes the
record with the largest id keeps the payload, and the others become revisit records that refer to it. Each record is a gzip member of
its own, as the format asks, so any reader can seek to it, and each archive begins with a warcinfo record. Revisits name the record,
target and date that they refer to, so readers need no headers of our own to resolve them. Archives go to the shared folder, one or more
per task, sorted, under names that follow from the task's number: a repeated task writes the very same files again.

Defined cases: a null payload is an empty one; a null url has an empty target; records of the keeper's own id with the same payload
(repeated rows) are responses too, under record ids of their own; null ids are dealt to tasks by url and payload; very long payloads are
one record; an empty table writes no archive and reads back as an empty table; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions_for, release, shared_dir, table, text_bytes, write_file

LEAST_BYTES = 1000
#: Uncompressed payload bytes in one archive, and per writing task.
FILE_BYTES, TASK_BYTES = 32 << 20, 32 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload string"


def resolve_revisits(headers: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, payload_digest, refers_to, target) of the records that revisit another; headers: page_id, url, payload_digest, payload_bytes."""
    long = headers.where(F.col("payload_bytes") >= least)
    kept = long.groupBy("payload_digest").agg(F.max(F.struct("page_id", "url")).alias("keeper"), F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    kept = kept.select("payload_digest", F.col("keeper.page_id").alias("refers_to"), F.col("keeper.url").alias("target"), "first", "n")
    kept = table(kept.where("n > 1 and (first < refers_to or first is null)").select("payload_digest", "refers_to", "target"), "warc-kept")
    # Both sides are plain exchanges here, so a digest with a large part of all records is split at run time.
    return long.join(kept, "payload_digest").where("page_id < refers_to").select("page_id", "payload_digest", "refers_to", "target").distinct()


def _record_id(page_id: int | None, url: str, digest: str, nth: int = 0) -> str:
    """The same for the same row in every run; nth tells repeated rows apart."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id} {digest} {url} {nth}'.encode()).digest())}>"


def _uri(url: str) -> str:
    return re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)


def _warc(head: list[str], block: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info(name: str, date: str) -> bytes:
    block = b"software: forestflux\r\nformat: WARC File Format 1.1\r\n"
    return _warc(["WARC-Type: warcinfo", f"WARC-Record-ID: {_record_id(None, name, 'info')}", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], block)


def _record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, target: str | None, nth: int, date: str) -> bytes:
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, url, digest, nth)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block = http + payload
    else:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, target, digest)}", f"WARC-Refers-To-Target-URI: {_uri(target)}", f"WARC-Refers-To-Date: {date}"]
        head += [f"X-Refers-To-Page-Id: {refers_to}", "WARC-Truncated: length"]
        block = http
    return _warc([*head, "Content-Type: application/http; msgtype=response"], block)


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str | None = None) -> DataFrame:
    """Writes deduplicated archives of all rows under folder; returns (file, records) of each. date: that of all records, now if none is given."""
    spark = pages.sparkSession
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    keyed = rows.withColumn("payload_digest", F.sha1(F.col("payload").cast("binary"))).withColumn("dealt", F.coalesce("page_id", F.xxhash64("url", "payload_digest")))
    headers = keyed.select("page_id", "url", "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes"))
    revisits = table(resolve_revisits(headers, least), "warc-revisits").withColumn("dealt", F.col("page_id"))
    _, total = text_bytes(rows, "payload")
    decided = keyed.repartition(partitions_for(rows, total, TASK_BYTES), "dealt").join(revisits, ["dealt", "page_id", "payload_digest"], "left")
    decided = decided.sortWithinPartitions("page_id", "payload_digest", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size, last, nth = TaskContext.get().partitionId(), 0, [], 0, None, 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            name = f"part-{part:06d}-{number:04d}.warc.gz"
            write_file(f"{folder}/{name}", b"".join([_gzip(_info(name, date)), *held]))
            out = pa.RecordBatch.from_pydict({"file": pa.array([name]), "records": pa.array([len(held)], pa.int64())})
            held.clear()
            number += 1
            return out

        for batch in batches:
            for page_id, url, payload, digest, refers_to, target in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "refers_to", "target"))):
                data, row = payload.encode(), (page_id, url, digest)
                nth = nth + 1 if row == last else 0
                last = row
                held.append(_gzip(_record(page_id, url, data, digest, refers_to, target, nth, date)))
                size += len(data)
                if size >= FILE_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    written = table(decided.mapInArrow(write, "file string, records long"), "warc-files")
    release(spark)
    return written


def _members(data: bytes) -> Iterator[bytes]:
    """The gzip members of an archive, without copying what is left of it for each."""
    view, at = memoryview(data), 0
    while at < len(data):
        unpacker, out = zlib.decompressobj(31), []
        while not unpacker.eof:
            if at >= len(data):
                raise ValueError("an archive ends inside a record")
            piece = view[at : at + (1 << 14)]
            out.append(unpacker.decompress(piece))
            at += len(piece) - len(unpacker.unused_data)
        yield b"".join(out)


def _parse(data: bytes) -> Iterator[tuple]:
    """Records of one archive."""
    for raw in _members(data):
        head, _, rest = raw.partition(b"\r\n\r\n")
        if b"\r\nWARC-Type: warcinfo\r\n" in head:
            continue
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        page_id, refers_to = (int(fields[k]) if k in fields else None for k in ("X-Page-Id", "X-Refers-To-Page-Id"))
        if fields["WARC-Type"] == "response":
            if hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"record of page {page_id} is damaged")
            yield page_id, fields["WARC-Target-URI"], "response", digest, len(payload), None, payload.decode()
        else:
            size = int(http.rpartition(b"Content-Length: ")[2])
            yield page_id, fields["WARC-Target-URI"], "revisit", digest, size, refers_to, None


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives under folder; payload is null for revisits, or throughout if payloads is False."""
    files = spark.read.format("binaryFile").load(f"{folder}/*.warc.gz").select("content")
    names = [f.strip().split(" ")[0] for f in _READ.split(",")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                rows, size = [], 0
                for row in _parse(value.as_py()):
                    rows.append(row if payloads else (*row[:-1], None))
                    size += row[4]
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return files.mapInArrow(read, _READ)


def archive_and_read(pages: DataFrame, least: int = LEAST_BYTES, payloads: bool = True, **columns) -> DataFrame:
    """Writes the archives to the shared folder and reads them back."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    if write_archives(pages, folder, least, **columns).isEmpty():
        return spark.createDataFrame([], _READ)
    return read_archives(spark, folder, payloads)
