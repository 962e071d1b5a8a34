"""WARC archives as chunked record tables.

A payload is a run of rows ``(record_id, chunk_no, data)`` of bounded size. The writer streams chunks into compressed
archives, the reader streams archives into chunks; both carry digests along from chunk to chunk and check them at a record's
end, and neither holds a whole record. A table of pages does hold whole payloads in its rows: they are hashed and cut
one row at a time by :func:`plan_records` and :func:`to_chunks`.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.common import Scratch, body, bounded_batches

CHUNK_BYTES = 1 << 18
READ_BYTES = 1 << 18
BATCH_BYTES = 1 << 22
LEVEL = 3

# Names and lines of the WARC 1.1 format.
VERSION = "WARC/1.1"
QUOTED = "X-Target-URI-Quoted"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"

CHUNKS = (
    "record_id string, chunk_no long, data binary, is_last boolean, record_type string, target_uri string,"
    " refers_to string, payload_bytes long, payload_digest string"
)


def plan_records(pages: DataFrame, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """Decide the type of each page's record: ``page_id, url, payload, sha1, refers_to``.

    Of pages with equal payloads of at least ``min_bytes`` bytes the one with the largest ``page_id`` is the response and
    ``refers_to`` is null; the others refer to it. Payloads are equal if SHA-1 and length are. Only digests are grouped,
    with a map-side part, so a payload that a third of all pages share makes no large task; handing the result back is
    a plain join. A null ``page_id`` ranks lowest. Of repeated rows each is a record; those of the response's id are
    all responses.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), body("html").cast("binary").alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "n": F.octet_length("payload").cast("long")})
    shared = rows.filter(F.col("n") >= min_bytes).groupBy("sha1", "n")
    shared = shared.agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).filter("copies > 1")
    shared = scratch.table(shared.select("sha1", "n", "keeper"), "shared")
    refers = F.when(~F.col("keeper").eqNullSafe(F.col("page_id")), F.col("keeper"))
    return rows.join(shared, ["sha1", "n"], "left").withColumn("refers_to", refers)


def to_chunks(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Cut payloads into chunk rows; a revisit has one row without data. The rows of a record stay together, in order."""
    stored = F.when(F.col("refers_to").isNull(), F.col("n")).otherwise(F.lit(0))
    numbers = F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(stored - 1, F.lit(0)) / chunk_bytes))
    offset = (F.col("chunk_no") * chunk_bytes).cast("int") + 1
    data = F.when(F.col("refers_to").isNull(), F.substring("payload", offset, chunk_bytes))
    return records.select("*", F.explode(numbers).alias("chunk_no")).select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("record_id"),
        "chunk_no",
        F.coalesce(data, F.lit(b"")).alias("data"),
        F.coalesce("url", F.lit("")).alias("target_uri"),
        F.col("refers_to").cast("string").alias("refers_to"),
        F.col("n").alias("payload_bytes"),
        F.col("sha1"),
    )


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _head(record_id: str, uri: str, refers_to: str | None, size: int, sha1: str) -> bytes:
    """The lines before a record's payload: WARC fields, then the HTTP response's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    # An address that a header line can hold stays as it is, percent signs too; another is quoted, which a field tells.
    plain = not uri or (uri.isascii() and uri.isprintable() and " " not in uri)
    fields = [
        VERSION,
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{record_id}>",
        f"WARC-Date: {EPOCH}",
        f"WARC-Target-URI: {uri if plain else quote(uri, safe=':/?#[]@!$&()*+,;=')}",
        f"WARC-Payload-Digest: sha1:{base32(bytes.fromhex(sha1))}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (size if refers_to is None else 0)}",
    ]
    if not plain:
        fields.append(f"{QUOTED}: yes")
    if refers_to is not None:
        fields += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + http


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Stream chunk rows into one compressed archive a task, a gzip member a record; returns ``path, records, size``.

    ``folder`` must be shared by all executors. Every attempt writes a file of its own name, and only files in the
    returned table count, so a repeated or lost attempt leaves nothing that is read. Write the returned table once and
    use what was written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = packer = path = record = None
        digest, records = hashlib.sha1(), 0
        whole = True  # a revisit has no payload to be checked

        def close() -> None:
            if not whole and digest.hexdigest() != record["sha1"]:
                raise ValueError(f"the chunks of record {record['record_id']} are not its payload")
            out.write(packer.compress(b"\r\n\r\n") + packer.flush())

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    system, inner = _open(path)
                    system.create_dir(inner.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(inner, compression=None)
                if row["chunk_no"] == 0:
                    if packer is not None:
                        close()
                    record, digest, whole = {k: row[k] for k in ("record_id", "sha1")}, hashlib.sha1(), row["refers_to"] is not None
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    records += 1
                    fields = (row["record_id"], row["target_uri"], row["refers_to"], row["payload_bytes"], row["sha1"])
                    out.write(packer.compress(_head(*fields)))
                digest.update(row["data"])
                out.write(packer.compress(row["data"]))
        if out is not None:
            close()
            size = out.tell()
            out.close()
            columns = [pa.array([path]), pa.array([records], pa.int64()), pa.array([size], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["path", "records", "size"])

    return chunks.mapInArrow(run, "path string, records long, size long")


class _Members(io.RawIOBase):
    """The decompressed bytes of concatenated gzip members, read in pieces of bounded size."""

    def __init__(self, source):
        self.source, self.unpacker, self.rest = source, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while True:
            if self.unpacker.eof:
                self.rest, self.unpacker = self.unpacker.unused_data or self.rest, zlib.decompressobj(31)
            packed = self.rest or self.source.read(READ_BYTES)
            if not packed:
                return 0
            out = self.unpacker.decompress(packed, len(target))
            self.rest = self.unpacker.unconsumed_tail
            if out:
                target[: len(out)] = out
                return len(out)


def _fields(stream: io.BufferedReader) -> dict[str, str]:
    """Header lines up to the empty one, names in lower case; the first line is kept under the empty name."""
    found: dict[str, str] = {}
    while line := stream.readline().rstrip(b"\r\n"):
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not found:
            found[""] = line.decode("utf-8", "replace")
        elif colon:
            found[name.strip().lower()] = value.strip()
    return found


def _records(stream: io.BufferedReader, chunk_bytes: int) -> Iterator[tuple]:
    """Chunk rows of an archive, with the payload's length and digest up to and including each chunk."""
    while True:
        top = _fields(stream)
        if not top:
            return
        if not top[""].startswith("WARC/"):
            raise ValueError(f"no record begins with {top['']!r}")
        left = int(top["content-length"])
        http = b""
        while not http.endswith(b"\r\n\r\n") and len(http) < left:
            http += stream.readline(left - len(http))
        inner = _fields(io.BufferedReader(io.BytesIO(http)))
        left -= len(http)
        kind = top.get("warc-type", "")
        name = top["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
        uri = top.get("warc-target-uri", "")
        uri = unquote(uri) if top.get(QUOTED.lower()) == "yes" else uri
        refers = top.get("warc-refers-to")
        refers = refers and refers.removeprefix("<urn:page:").removesuffix(">")
        stated = top.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "revisit":
            yield name, 0, b"", True, kind, uri, refers, int(inner.get("content-length", 0)), stated
        else:
            digest, size, number = hashlib.sha1(), 0, 0
            while True:
                data = stream.read(min(chunk_bytes, left))
                if len(data) < min(chunk_bytes, left):
                    raise EOFError(f"record {name} is cut off")
                left -= len(data)
                size += len(data)
                digest.update(data)
                so_far = base32(digest.digest())
                if not left and stated and so_far != stated:
                    raise ValueError(f"record {name} does not have the digest it states")
                yield name, number, data, not left, kind, uri, refers, size, so_far
                number += 1
                if not left:
                    break
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {name} has no end")


def read_archives(files: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """Read archives (column ``path``) into chunk rows, each file as a stream.

    ``payload_bytes`` and ``payload_digest`` of a chunk cover the payload up to its end, so a record's last chunk
    (``is_last``) has those of the whole. A revisit has one row with what its header states. A damaged archive fails
    with the record's name. ``with_data=False`` leaves the bytes out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, inner = _open(path)
                with system.open_input_stream(inner, compression=None) as source:
                    rows, held = [], 0
                    for row in _records(io.BufferedReader(_Members(source), READ_BYTES), chunk_bytes):
                        held += len(row[2]) + 200
                        rows.append(row if with_data else (*row[:2], None, *row[3:]))
                        if held >= BATCH_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    kinds = [pa.string(), pa.int64(), pa.binary(), pa.bool_(), *[pa.string()] * 3, pa.int64(), pa.string()]
    names = [c.split()[0] for c in CHUNKS.split(",")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return files.select("path").mapInArrow(run, CHUNKS)


def store_and_index(pages: DataFrame, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """Write a record per page, read the archives back, and describe each page's record from what was read.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``, one row per input row. Null html is an empty
    payload; a null url an empty one. A null ``page_id``, and one that is an empty string, is written as an empty name and
    read back as null. An empty
    table gives no archive and an empty result. Other columns are ignored.
    """
    spark: SparkSession = bounded_batches(pages.sparkSession)
    chunks = to_chunks(plan_records(pages, scratch, min_bytes))
    files = scratch.table(write_archives(chunks, f"{scratch.path}/archives"), "files")
    # A task per archive, as many as were written.
    many = max(1, files.count())
    rows = read_archives(files.repartition(many), with_data=False).filter("is_last")
    key = pages.schema["page_id"].dataType.simpleString()
    return rows.select(
        F.expr(f"try_cast(nullif(record_id, '') AS {key})").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.expr(f"try_cast(refers_to AS {key})").alias("refers_to"),
    )
