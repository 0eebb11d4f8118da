"""WARC archives as a table of record chunks.

A record becomes rows (archive, record, chunk, chunks, data) of at most
``CHUNK`` payload bytes each, so an oversized payload is written and read as a
stream. The writer slices the payload where it lies (in the batch that holds the
page), runs a SHA-1 over the slices, writes it into the header and yields chunk
rows in batches of about ``BATCH`` bytes: beside the page itself it holds one
such batch. Readers carry the header's remainder and a running SHA-1 from chunk
to chunk. Records of one chunk are read where they lie; only the chunks of
longer ones are shuffled and sorted by (archive, record, chunk).

Of records with equal payloads of at least ``least`` bytes the one with the
largest key is a response and the others revisit it. That is settled on a stored
table of keys and digests, without payloads; a hot digest is combined before its
shuffle and the join is a plain equi-join, which Spark splits where skewed.
Revisits need no payload and come from that table; responses are the pages that
are not among them, by a join on (digest, key) that is broadcast where few keys
revisit and spreads copies evenly where many do.

Defined cases: a null payload is empty; rows whose key is null revisit if an
equal payload has a key and are responses otherwise; repeated rows with the
largest key are all responses; line breaks in a URL are percent-encoded; an
empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_keys, stored

CHUNK, BATCH, LEAST = 8 << 10, 1 << 20, 1000
NAME = "urn:millrace:page:"
ROWS = "archive bigint, record bigint, chunk int, chunks int, data binary"
READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"


def header(key: int | None, url: str | None, kind: str, digest: str, size: int, refers_to: int | None) -> bytes:
    """WARC and HTTP header of one record; a revisit's block is its HTTP header alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    length = len(block) + (size if kind == "response" else 0)
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{NAME}{'' if key is None else key}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"WARC-Payload-Digest: sha1:{sha}",
        *([f"WARC-Refers-To: <{NAME}{refers_to}>"] if kind == "revisit" else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {length}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def planned(pages: DataFrame, key: str, payload: str, url: str, least: int) -> DataFrame:
    """key, url and either a payload (responses) or the digest, size and key that they refer to (revisits)."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).cast("bigint").alias("key"), F.col(url).cast("string").alias("url"), body.alias("payload"), F.sha1(body).alias("digest"))
    facts = stored(rows.select("key", "url", "digest", F.octet_length("payload").cast("bigint").alias("size")))
    large = facts.where(F.col("size") >= least)
    first = large.groupBy("digest").agg(F.max("key").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    other = F.col("key").isNull() | (F.col("key") < F.col("refers_to"))
    revisits = stored(large.join(first.select("digest", "refers_to"), "digest").where(other).select("key", "url", "digest", "size", "refers_to"))
    # Null keys compare as a value of their own.
    known = F.struct("digest", F.coalesce("key", F.lit(0)).alias("key"), F.col("key").isNull().alias("missing")).alias("known")
    responses = by_keys(rows.withColumn("known", known), revisits.select(known).distinct(), "known", "left_anti")
    none = F.lit(None)
    return responses.select("key", "url", "payload", none.cast("string").alias("digest"), none.cast("bigint").alias("size"), none.cast("bigint").alias("refers_to")).unionByName(
        revisits.select("key", "url", none.cast("string").alias("payload"), "digest", "size", "refers_to")
    )


def slices(payload: memoryview, chunk: int) -> Iterator[memoryview]:
    """The payload in chunks, not copied; an empty one is one chunk."""
    for k in range(max(1, -(-len(payload) // chunk))):
        yield payload[k * chunk : (k + 1) * chunk]


def chunk_batches(batches: Iterator[pa.RecordBatch], archive: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """The chunk rows of one archive, in batches of about ``BATCH`` bytes."""
    out, size, record = [], 0, 0

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        r, k, n, data = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([archive] * len(r), pa.int64()), pa.array(r, pa.int64()), pa.array(k, pa.int32()), pa.array(n, pa.int32()), pa.array(data, pa.binary())],
            names=["archive", "record", "chunk", "chunks", "data"],
        )

    for batch in batches:
        payloads = batch.column("payload")
        keys, urls, digests, sizes, refs = (batch.column(x).to_pylist() for x in ("key", "url", "digest", "size", "refers_to"))
        for i in range(batch.num_rows):
            kind = "response" if refs[i] is None else "revisit"
            payload = memoryview(payloads[i].as_buffer()) if kind == "response" else memoryview(b"")
            digest, length = digests[i], sizes[i]
            if kind == "response":
                sha, length = hashlib.sha1(), len(payload)
                for part in slices(payload, chunk):
                    sha.update(part)
                digest = sha.hexdigest()
            n = max(1, -(-len(payload) // chunk))
            for k, part in enumerate(slices(payload, chunk)):
                head = header(keys[i], urls[i], kind, digest, length, refs[i]) if k == 0 else b""
                data = b"".join((head, part, b"\r\n\r\n" if k == n - 1 else b""))
                out.append((record, k, n, data))
                size += len(data)
                if size >= BATCH:
                    yield batch_of(out)
                    out, size = [], 0
            record += 1
    if out:
        yield batch_of(out)


def chunked(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of ``planned`` records, in the order of their archive (one archive a task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        return chunk_batches(batches, task.partitionId() if task else 0, chunk)

    return rows.mapInArrow(run, ROWS)


class Reader:
    """One record, chunk by chunk: headers first, then a running digest; four bytes are held back for the end mark."""

    def __init__(self) -> None:
        self.fields: dict[str, str] | None = None
        self.pending, self.sha, self.read = b"", hashlib.sha1(), 0

    def add(self, data: bytes) -> None:
        data = self.pending + data
        if self.fields is None:
            first = data.find(b"\r\n\r\n")
            second = data.find(b"\r\n\r\n", first + 4)
            if first < 0 or second < 0:
                self.pending = data
                return
            lines = data[: second].decode().split("\r\n")
            self.fields = {}
            for line in lines:
                name, mark, value = line.partition(": ")
                if mark:  # the WARC header's own length comes first; the HTTP header's is the payload's
                    self.fields["Payload-Length" if name == "Content-Length" and name in self.fields else name] = value
            data = data[second + 4 :]
        self.pending = data[-4:]
        body = data[:-4]
        self.sha.update(body)
        self.read += len(body)

    def row(self) -> tuple:
        """What the record says, held against what was read; raises if they differ."""
        f = self.fields
        if f is None or self.pending != b"\r\n\r\n":
            raise ValueError("a record has no complete header or end")
        kind, size = f["WARC-Type"], int(f["Payload-Length"])
        digest = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        if kind == "response" and (self.read != size or self.sha.hexdigest() != digest):
            raise ValueError(f"payload of {f['WARC-Record-ID']} differs from its header")

        def number(x: str | None) -> int | None:
            x = (x or "").strip("<>").removeprefix(NAME)
            return int(x) if x else None

        return number(f["WARC-Record-ID"]), size, digest, kind, number(f.get("WARC-Refers-To")), f["WARC-Target-URI"]


def parsed(chunks: DataFrame) -> DataFrame:
    """A row per record of chunk rows that stand in order within each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            out = []
            for data, k, n in zip(batch.column("data"), batch.column("chunk").to_pylist(), batch.column("chunks").to_pylist(), strict=True):
                if k == 0:
                    reader = Reader()
                reader.add(data.as_py())
                if k == n - 1:
                    out.append(reader.row())
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"],
                )

    return chunks.select("chunk", "chunks", "data").mapInArrow(run, READ)


def read_archives(chunks: DataFrame) -> DataFrame:
    """A row per record of a stored chunk table."""
    whole = chunks.where("chunks = 1")
    long = chunks.where("chunks > 1").repartition(F.col("archive"), F.col("record")).sortWithinPartitions("archive", "record", "chunk")
    return parsed(whole).unionByName(parsed(long))


def written(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """The stored chunk table of all pages."""
    return stored(chunked(planned(pages, key, payload, url, least), chunk))
