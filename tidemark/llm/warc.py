r"""WARC archives (operator 6): a writer, and a sequential reader.

Each record is a gzip member of its own. The writer puts one archive a task into a folder that all executors share and
returns the paths; a path counts only once the task's row is written, so a task that is run again leaves a stray file
and no wrong record. The reader goes through an archive from front to back: it inflates one member at a time, CHUNK
bytes of file after another, splits the header at the empty line, takes as many bytes as Content-Length says, and
compares block and payload with their digests. A record that breaks a rule raises ValueError with the place.

Pages with equal payloads of at least LEAST bytes: the one with the smallest id is stored as `response`, the others
as `revisit`, with the HTTP header only, which says how long the payload is. Equality is that of SHA-1 and length.

Defined cases: a null payload is empty. Of several rows with the smallest id and the same payload all are responses. A
null id never wins over another; if all ids of a payload are null, all are responses. Null urls are written as
`urn:x-page:<id>`. Other columns are ignored. An empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, new_folder, written

CHUNK = 1 << 16
LEAST = 0
LEVEL = 6
_VERSION = b"WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"
_DATE = "2024-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: bytes | None, payload: bytes, payload_digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit carries no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = (url or f"{_ID}{page_id}".encode()).replace(b"\r", b"%0D").replace(b"\n", b"%0A")
    head = [
        _VERSION,
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>".encode(),
        f"WARC-Date: {_DATE}".encode(),
        b"WARC-Target-URI: " + uri,
        f"WARC-Payload-Digest: sha1:{payload_digest}".encode(),
        f"WARC-Block-Digest: sha1:{digest(block)}".encode(),
        b"Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}".encode(),
    ]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}".encode(), f"WARC-Refers-To: <{_ID}{'' if refers_to is None else refers_to}>".encode()]
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def members(stream: BinaryIO, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """The place and the content of each gzip member of a stream; holds one member and one chunk."""
    place = at = 0
    rest = b""
    while True:
        inflate, parts, got = zlib.decompressobj(31), [], False
        while not inflate.eof:
            data = rest or stream.read(chunk)
            rest = b""
            if not data:
                if got:
                    raise ValueError(f"the member at {place} ends early")
                return
            got = True
            at += len(data)
            try:
                parts.append(inflate.decompress(data))
            except zlib.error as e:
                raise ValueError(f"the member at {place} can't be inflated: {e}") from None
        rest = inflate.unused_data
        at -= len(rest)
        yield place, b"".join(parts)
        place = at


def _split(data: bytes, place: int) -> tuple[bytes, dict[str, bytes], bytes]:
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        raise ValueError(f"at {place}: the header has no end")
    first, *lines = head.split(b"\r\n")
    pairs = (x.partition(b":") for x in lines)
    return first, {k.strip().lower().decode("latin-1"): v.strip() for k, _, v in pairs}, rest


def read_records(stream: BinaryIO) -> Iterator[dict]:
    """The records of an archive, one after another: type, page_id, url, refers_to, payload (None for a revisit), payload_bytes, payload_digest."""
    for place, data in members(stream):
        first, head, rest = _split(data, place)
        if first != _VERSION:
            raise ValueError(f"at {place}: not a {_VERSION.decode()} record")
        n = int(head["content-length"])
        block = rest[:n]
        if len(block) != n or rest[n:] != b"\r\n\r\n":
            raise ValueError(f"at {place}: Content-Length {n} does not frame the block")
        if "sha1:" + digest(block) != head["warc-block-digest"].decode():
            raise ValueError(f"at {place}: the block has another digest")
        _, http, payload = _split(block, place)
        kind, size, said = head["warc-type"].decode(), int(http["content-length"]), head["warc-payload-digest"].decode().removeprefix("sha1:")
        if kind == "response" and (len(payload) != size or digest(payload) != said):
            raise ValueError(f"at {place}: the payload has another length or digest")

        def page(name: str, head=head) -> int | None:
            ref = head.get(name, b"").decode().strip("<>").removeprefix(_ID)
            return int(ref) if ref else None

        yield {"record_type": kind, "page_id": page("warc-record-id"), "url": head["warc-target-uri"], "refers_to": page("warc-refers-to"), "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": said}


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """Writes pages to archives in folder, a shared URI; returns path and n_records of each archive, as a written table."""
    payload = F.coalesce(F.col(html), F.lit(""))
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("html"))
    own = own.withColumns({"sha": F.sha1("html"), "n": F.octet_length("html")})
    first = own.where(F.col("n") >= least).groupBy("sha", "n").agg(F.min("page_id").alias("first"))
    # a payload that many pages share is a hot key of this join, which Spark splits; the other side has a row for each payload
    placed = own.join(first, ["sha", "n"], "left").select("page_id", "url", "html", "sha", "first")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, task = None, 0, TaskContext.get()
        for b in batches:
            if out is None and b.num_rows:
                path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
                system, place = _file_system(path)
                system.create_dir(place.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(place)
            for i, u, h, sha, f in zip(b.column(0).to_pylist(), as_bytes(b, "url"), as_bytes(b, "html"), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                out.write(record(i, u, h, base64.b32encode(bytes.fromhex(sha)).decode(), f, f is not None and f != i))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n_records"])

    return written(placed.mapInArrow(each, "path string, n_records long"), "archives")


def read_archives(archives: DataFrame, with_payload: bool = True, rows: int = 256) -> DataFrame:
    """The records of the archives at column path."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(found: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(found, schema)

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.binary()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), *([("payload", pa.binary())] if with_payload else [])])
        for b in batches:
            for path in b.column(0).to_pylist():
                system, place = _file_system(path)
                found: list[dict] = []
                with system.open_input_stream(place) as stream:
                    for r in read_records(stream):
                        found.append({k: r[k] for k in schema.names})
                        if len(found) == rows:
                            yield batch(found)
                            found = []
                if found:
                    yield batch(found)

    # as many tasks as archives: each is read from front to back
    return archives.select("path").repartition(max(1, archives.count())).mapInArrow(each, "page_id long, url binary, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_folder(spark, "warc"))
    return read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("url").cast("string").alias("url"))
