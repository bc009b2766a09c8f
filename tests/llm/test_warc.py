"""WARC archives: exact round trip, chunk by chunk."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from treeline.llm import warc


def _archive(df, **more):
    return warc.archive(df.withColumn("url", F.lit("http://a/b c\n")), "doc_id", "text", "url", "2020-01-01T00:00:00Z", **more)


def test_round_trip(odd, none):
    rows = [(r.doc_id, (r.text or "").encode()) for r in odd.select("doc_id", "text").collect() if r.doc_id is not None]
    last = {}
    for i, t in rows:
        last[t] = max(i, last.get(t, i))
    want = sorted((i, len(t), base64.b32encode(hashlib.sha1(t).digest()).decode(),
                   "response" if last[t] == i else "revisit", None if last[t] == i else last[t]) for i, t in rows)
    out = warc.read(_archive(odd, chunk_bytes=100))
    got = sorted((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect())
    assert got == want
    assert {r.uri for r in out.collect()} == {"http://a/b%20c%0A"}
    assert warc.read(_archive(none)).count() == 0


def test_small_payloads_are_never_revisits(odd):
    out = warc.read(_archive(odd, least_bytes=100))
    assert {r.record_type for r in out.where("payload_bytes < 100").collect()} == {"response"}
    assert out.where("record_type = 'revisit'").count() > 0


def test_archives_are_plain_warc(odd):
    manifest = _archive(odd.where("doc_id in (1, 2, 4)"))
    found = b"".join(gzip.open(r.file.removeprefix("file://")).read() for r in manifest.collect())
    records = found.split(b"WARC/1.1\r\n")[1:]
    assert len(records) == 3 == manifest.agg(F.sum("records")).first()[0]
    for r in records:
        head, _, rest = r.partition(b"\r\n\r\n")
        length = int([x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")][0].split()[1])
        assert len(rest) == length + 4 and rest.endswith(b"\r\n\r\n")


def test_any_order_of_chunks(odd):
    rows = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    chunks = warc.chunked(rows, "doc_id", "text", 50)
    mixed = warc.in_order(chunks.orderBy(F.xxhash64("record_id", "chunk_no")))
    assert sorted(warc.digests(mixed).collect()) == sorted(warc.digests(chunks).collect())


def test_damage_ends_the_job(odd, tmp_path):
    manifest = _archive(odd.where("doc_id = 7"), folder=f"file://{tmp_path}/w")
    file = manifest.first().file.removeprefix("file://")
    whole = gzip.open(file).read()
    with gzip.open(file, "wb") as f:
        f.write(whole[:-40] + bytes([whole[-40] ^ 1]) + whole[-39:])
    with pytest.raises(Exception, match="damaged"):
        warc.read(manifest).collect()
