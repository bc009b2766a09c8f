"""WARC archives over a chunked record table.

A payload is rows (record_id, chunk_no, data) of at most `chunk_bytes` each, in order. A
task carries the digest of the record at hand from chunk to chunk and never holds a whole
payload: digests, writing (one gzip member per record) and reading all stream. Of records
with equal payloads that with the largest id is the response, the others revisit it.

Archives lie in a new folder below `spark.checkpoint.dir`, or in one that is given. A task
names its files by its attempt and reports them in the result it returns; the manifest
written from these results lists the files of the attempts that counted, so a lost
executor or a second attempt leaves files that nobody reads, never a wrong archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.store import lookup, new_folder, parts, stored

CHUNK_BYTES = 32 << 10
#: A writer begins a new file beyond so many bytes.
ARCHIVE_BYTES = 1 << 30
_DIGEST = "urn:sha1:"
_BLOCK_END = b"\r\n\r\n"


def chunked(records: DataFrame, id_col: str, payload_col: str, chunk_bytes: int = CHUNK_BYTES,
            carry: tuple[str, ...] = ()) -> DataFrame:
    """(record_id, carried columns, chunk_no, data): each payload in order, one chunk at least.

    A null payload is an empty one. Text counts in UTF-8.
    """
    whole = records.select(F.col(id_col).cast("long").alias("record_id"), *carry,
                           F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("_payload"))
    last = F.greatest(F.ceil(F.octet_length("_payload") / chunk_bytes), F.lit(1)).cast("int") - 1
    each = whole.select("record_id", *carry, "_payload", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    part = F.substring(F.col("_payload"), F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))
    return each.select("record_id", *carry, "chunk_no", part.alias("data"))


def in_order(chunks: DataFrame) -> DataFrame:
    """An arbitrary chunk table with the chunks of each record together and in order."""
    return chunks.repartition(parts(chunks), "record_id").sortWithinPartitions("record_id", "chunk_no")


def _base32(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, size, sha1 = None, 0, None
    for batch in batches:
        out: list[tuple[int, int, str]] = []
        for i, k, data in zip(batch.column("record_id").to_pylist(), batch.column("chunk_no").to_pylist(),
                              batch.column("data")):
            if k == 0:
                if sha1 is not None:
                    out.append((now, size, _base32(sha1)))
                now, size, sha1 = i, 0, hashlib.sha1()
            piece = data.as_buffer()
            sha1.update(piece)
            size += piece.size
        yield _rows(out)
    if sha1 is not None:
        yield _rows([(now, size, _base32(sha1))])


def _rows(out: list[tuple[int, int, str]]) -> pa.RecordBatch:
    ids, sizes, digests = zip(*out) if out else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
        ["record_id", "payload_bytes", "payload_digest"])


def digests(chunks: DataFrame) -> DataFrame:
    """(record_id, payload_bytes, payload_digest) of records whose chunks stand in order."""
    return chunks.select("record_id", "chunk_no", "data").mapInArrow(
        _digests, "record_id bigint, payload_bytes bigint, payload_digest string")


def roles(of: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds refers_to: the response that a record revisits, else null.

    Payloads of fewer than `least_bytes` bytes are never revisits.
    """
    of = stored(of, "digests")
    same = of.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(
        F.max("record_id").alias("_response"), F.count("*").alias("_n")).where("_n > 1")
    found = lookup(of, same, ["payload_digest", "payload_bytes"], "_n", of.count(), parts(of))
    refers = F.when(F.col("_response") != F.col("record_id"), F.col("_response"))
    return found.select("record_id", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def _header(row: dict, date: str) -> tuple[bytes, bool]:
    """WARC and HTTP header of a record, and whether its payload follows."""
    revisit = row["refers_to"] is not None
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {row['payload_bytes']}\r\n\r\n").encode()
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["uri"] or "")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-row:{row['record_id']}>", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else row['payload_bytes'])}"]
    if uri:
        lines.append(f"WARC-Target-URI: {uri}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:x-row:{row['refers_to']}>")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http, not revisit


def _writer(folder: str, date: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        place, path = fs.FileSystem.from_uri(folder)
        place.create_dir(path, recursive=True)
        task = TaskContext.get()
        stem = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        files: list[tuple[str, int, int]] = []
        out, gz, follows, number = None, None, False, 0

        def end_record() -> None:
            nonlocal gz
            if gz is not None:
                out.write(gz.compress(_BLOCK_END) + gz.flush())
                gz = None

        def end_file() -> None:
            nonlocal out
            if out is not None:
                files.append((name, out.tell(), n))
                out.close()
                out = None

        name, n = "", 0
        for batch in batches:
            rows = batch.select([c for c in batch.schema.names if c != "data"]).to_pylist()
            for row, data in zip(rows, batch.column("data")):
                if row["chunk_no"] == 0:
                    end_record()
                    if out is not None and out.tell() > archive_bytes:
                        end_file()
                    if out is None:
                        name, n = f"{stem}-{number:04d}.warc.gz", 0
                        number += 1
                        out = place.open_output_stream(f"{path}/{name}", compression=None)
                    head, follows = _header(row, date)
                    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                    out.write(gz.compress(head))
                    n += 1
                if follows:
                    out.write(gz.compress(data.as_buffer()))
        if out is not None:
            end_record()
            end_file()
        names, sizes, counts = zip(*files) if files else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{x}" for x in names], pa.string()), pa.array(sizes, pa.int64()),
             pa.array(counts, pa.int64())], ["file", "bytes", "records"])
    return run


def write(chunks: DataFrame, date: str, folder: str | None = None,
          archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ordered chunks with their roles as archives; returns the stored manifest.

    chunks: record_id, uri, payload_bytes, payload_digest, refers_to, chunk_no, data. The
    manifest has file, bytes and records. Empty partitions write no file.
    """
    folder = folder or new_folder(chunks.sparkSession, "warc")
    return stored(chunks.mapInArrow(
        _writer(folder, date, archive_bytes), "file string, bytes bigint, records bigint"), "manifest")


class _Stream:
    """The decoded bytes of consecutive gzip members, read piece by piece."""

    def __init__(self, source):
        self.source, self.gz, self.raw, self.held = source, None, b"", b""

    def more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.source.read(1 << 18)
                if not self.raw:
                    return False
            self.gz = self.gz or zlib.decompressobj(31)
            got = self.gz.decompress(self.raw, 1 << 18)
            self.raw = self.gz.unused_data if self.gz.eof else self.gz.unconsumed_tail
            if self.gz.eof:
                self.gz = None
            if got:
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        at = self.held.find(mark)
        while at < 0:
            if not self.more():
                if self.held:
                    raise ValueError("archive ends inside a header")
                return None
            at = self.held.find(mark)
        found, self.held = self.held[:at], self.held[at + len(mark):]
        return found

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError("archive ends inside a record")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            yield piece


def _records(place, path: str) -> Iterator[tuple]:
    with place.open_input_stream(path, compression=None) as source:
        stream = _Stream(source)
        while (head := stream.until(b"\r\n\r\n")) is not None:
            lines = head.decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no record where one has to begin in {path}")
            fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            left = int(fields["content-length"])
            http = stream.until(b"\r\n\r\n")
            left -= len(http) + 4
            length = int(re.search(rb"(?i)content-length:\s*(\d+)", http)[1])
            sha1, size = hashlib.sha1(), 0
            for piece in stream.pieces(left):
                sha1.update(piece)
                size += len(piece)
            if b"".join(stream.pieces(4)) != _BLOCK_END:
                raise ValueError(f"a record of {path} does not end where it should")
            row, digest = int(fields["warc-record-id"][11:-1]), fields["warc-payload-digest"][5:]
            kind, refers = fields["warc-type"], fields.get("warc-refers-to")
            if kind == "response" and (_base32(sha1) != digest or size != length):
                raise ValueError(f"record {row} of {path} is damaged")
            yield row, length, digest, kind, int(refers[11:-1]) if refers else None, fields.get("warc-target-uri")


_FIELDS = [("record_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
           ("record_type", pa.string()), ("refers_to", pa.int64()), ("uri", pa.string())]


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for file in batch.column("file").to_pylist():
            place, path = fs.FileSystem.from_uri(file)
            rows: list[tuple] = []
            for row in _records(place, path):
                rows.append(row)
                if len(rows) == 4096:
                    yield _table(rows)
                    rows = []
            yield _table(rows)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS)], [name for name, _ in _FIELDS])


def read(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives: its id, size, digest, type, refers_to and uri.

    Digests of responses are computed from what was read; a response that differs from its
    header ends the job, as does an archive that ends early.
    """
    files = manifest.select("file").repartition(parts(manifest), F.xxhash64("file"))
    return files.mapInArrow(
        _reader, "record_id bigint, payload_bytes bigint, payload_digest string,"
        " record_type string, refers_to bigint, uri string")


def archive(records: DataFrame, id_col: str, payload_col: str, uri_col: str, date: str,
            folder: str | None = None, chunk_bytes: int = CHUNK_BYTES, least_bytes: int = 0) -> DataFrame:
    """Write one record per row; returns the manifest.

    A null payload is empty, a null uri is left out, and other columns are not read. Ids
    are distinct numbers; repeated rows give repeated records, and rows without an id cannot
    be named in an archive and are left out. An empty table writes no file.
    """
    records = records.where(F.col(id_col).isNotNull())
    role = roles(digests(chunked(records, id_col, payload_col, chunk_bytes)), least_bytes).dropDuplicates(["record_id"])
    rows = records.select(F.col(id_col).cast("long").alias("record_id"), F.col(uri_col).alias("uri"),
                          F.col(payload_col).alias("_body"))
    known = rows.join(role, "record_id")
    carried = ("uri", "payload_bytes", "payload_digest", "refers_to")
    return write(chunked(known, "record_id", "_body", chunk_bytes, carried), date, folder)


def session_date(spark: SparkSession) -> str:
    """The time at which the application began, as archives state it."""
    return spark.range(1).select(F.date_format(
        F.timestamp_millis(F.lit(spark.sparkContext.startTime)), "yyyy-MM-dd'T'HH:mm:ss'Z'")).first()[0]
