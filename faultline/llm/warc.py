"""WARC archives: writing, and a normaliser for archives that are one gzip stream.

Archives travel as rows (file, content), the shape in which Spark reads binary files, so archives made
elsewhere come in through ``spark.read.format("binaryFile")`` with ``path`` renamed.

* ``write_archives`` packs records into gzip streams that span whole files.
* ``normalise`` inflates each stream once, piece by piece, writes every record as a gzip member of its own,
  and gives each file an index of (offset, length, kind, record id).
* ``read_records`` opens single members by that index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import slices, written

ARCHIVE_BYTES = 8 << 20
PIECE = 1 << 20
LEVEL = 4
GZIP = 31  # window bits that stand for a gzip wrapper
FIXED_DATE = "2024-01-01T00:00:00Z"  # the rows carry no date, and equal inputs shall give equal archives

INDEX = "array<struct<offset: long, length: long, kind: string, record_id: string>>"
INDEX_ARROW = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("record_id", pa.string())]))


def with_record_type(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``sha1``, ``record_type`` and ``refers_to`` of each page.

    Of equal payloads of ``least_bytes`` or more the largest page_id is the response and the others revisit
    it; rows that repeat that page_id are responses too. A null html is the empty payload. A null page_id
    revisits the largest known one, or is a response if there is none.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    best = rows.groupBy("sha1").agg(F.max("page_id").alias("best"))
    revisit = (F.octet_length("payload") >= least_bytes) & F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    return rows.join(best, "sha1").select(
        "page_id", "url", "payload", "sha1", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("best")).alias("refers_to"))


def _record(page_id: int | None, url: str | None, payload: bytes, sha1: str, kind: str, refers_to: int | None) -> bytes:
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    target = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {FIXED_DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(file, content): each content one gzip stream over some records, about ``archive_bytes`` before packing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size, pieces, packer = TaskContext.get().partitionId(), 0, 0, [], None

        def closed() -> pa.RecordBatch:
            pieces.append(packer.flush())
            return _files([f"part-{part:05d}-{number:05d}.warc.gz"], [b"".join(pieces)])

        for batch in slices(batches, 64):
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "record_type", "refers_to"))
            for row in zip(*columns):
                packer = packer or zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                data = _record(*row)
                pieces.append(packer.compress(data))
                size += len(data)
                if size >= archive_bytes:
                    yield closed()
                    number, size, pieces, packer = number + 1, 0, [], None
        if packer is not None:
            yield closed()

    return records.select("page_id", "url", "payload", "sha1", "record_type", "refers_to").mapInArrow(run, "file string, content binary")


def _files(names: list[str], contents: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["file", "content"])


def inflated(content: bytes) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in pieces."""
    at, stream = 0, None
    while at < len(content):
        stream = stream or zlib.decompressobj(GZIP)
        chunk = content[at:at + PIECE]
        at += len(chunk)
        data = stream.decompress(chunk, PIECE)
        while data or stream.unconsumed_tail:
            yield data
            data = stream.decompress(stream.unconsumed_tail, PIECE) if stream.unconsumed_tail else b""
        if stream.eof:
            at -= len(stream.unused_data)
            stream = None
    if stream is not None:
        raise ValueError("the archive ends inside a gzip member")


def _head(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records_of(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, record bytes) of the records in a stream."""
    have = bytearray()
    for piece in pieces:
        have += piece
        at = 0
        while True:
            end = have.find(b"\r\n\r\n", at)
            if end < 0:
                break
            head = _head(bytes(have[at:end]))
            stop = end + 4 + int(head.get("content-length", 0)) + 4
            if stop > len(have):
                break
            yield head, bytes(have[at:stop])
            at = stop
        del have[:at]
    if have.strip():
        raise ValueError("the archive ends inside a record")


def normalise(archives: DataFrame, file_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(file, content, index): every record a gzip member; a new file begins when one reaches ``file_bytes``.

    A file cut short raises: half a record is never passed on as whole. An empty content gives no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            name, content = batch.column("file")[0].as_py(), batch.column("content")[0].as_py() or b""
            number, members, index, offset = 0, [], [], 0

            def closed() -> pa.RecordBatch:
                one = _files([f"{name.removesuffix('.warc.gz')}-{number:05d}.warc.gz"], [b"".join(members)])
                return pa.RecordBatch.from_arrays([*one.columns, pa.array([index], INDEX_ARROW)], names=["file", "content", "index"])

            for head, record in records_of(inflated(content)):
                member = gzip.compress(record, LEVEL, mtime=0)
                index.append({"offset": offset, "length": len(member), "kind": head.get("warc-type"), "record_id": head.get("warc-record-id")})
                members.append(member)
                offset += len(member)
                if offset >= file_bytes:
                    yield closed()
                    number, members, index, offset = number + 1, [], [], 0
            if members:
                yield closed()

    return archives.select("file", "content").mapInArrow(run, f"file string, content binary, index {INDEX}")


def _page(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "null" else int(value)


def read_records(files: DataFrame) -> DataFrame:
    """One row per index entry: page id, url, payload size and digest, kind, what it refers to, and the payload it holds.

    A response whose payload does not match its digest raises.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            content, index, out = batch.column("content")[0].as_py(), batch.column("index")[0].as_py(), []
            for entry in index:
                data = zlib.decompress(content[entry["offset"]:entry["offset"] + entry["length"]], GZIP)
                cut = data.index(b"\r\n\r\n")
                head, block = _head(data[:cut]), data[cut + 4:-4]
                cut = block.index(b"\r\n\r\n")
                http, payload = _head(block[:cut]), block[cut + 4:]
                kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"{head['warc-record-id']} does not match its digest")
                refers = _page(head["warc-refers-to"]) if kind == "revisit" else None
                out.append((_page(head["warc-record-id"]), head["warc-target-uri"], int(http["content-length"]), digest, kind, refers, payload if kind == "response" else None))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=schema.replace(",", "").split()[::2])

    return files.mapInArrow(run, schema)


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Normalised files of the pages, written to the shared folder (gzip already packs them)."""
    archives = written(write_archives(with_record_type(pages, least_bytes)), "none")
    return written(normalise(archives), "none")
