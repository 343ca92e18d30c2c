"""The WARC source: round trips, ranges of every size, archives inside payloads, broken records."""

from __future__ import annotations

import gzip
import hashlib
import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import warc
from plumbline.llm.queries import op12_warc

LONG = "<p>" + "long text " * 30
SCHEMA = "page_id long, url string, html string, offset long"
ROWS = [
    (5, "http://a/ä b\r\nX: y", LONG, 1), (3, None, LONG, 1), (9, "", LONG, 1), (3, "http://c", LONG, 1), (None, "http://d", LONG, 1), (8, "u", "short", 1), (1, "u", "short", 1), (2, "u", None, 1),
    (4, "u", "", 1), (11, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 9, 1), (12, "u", "ß" * 50, 1), (10, "u", "ß" * 50, 1), (13, "u", "x" * 99, 1), (14, "u", "x" * 99, 1), (None, None, "only null ids " * 9, 1), (None, None, "only null ids " * 9, 1),
    (15, "u", "".join(chr(random.Random(1).randrange(32, 0xD000)) for _ in range(200_000)), 1),
]


def want(rows):
    """A row a page: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    out, seen = [], {}
    for page, _, html, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        payload = (html or "").encode()
        digest = hashlib.sha256(payload).hexdigest()
        again = len(payload) >= 100 and digest in seen
        out.append((page, len(payload), digest, "revisit" if again else "response", seen[digest] if again else None))
        seen.setdefault(digest, page)
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


@pytest.mark.parametrize("range_bytes", [700, 5_000, 1 << 20])
def test_pages_come_back(spark, range_bytes):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    assert got(warc.archived_pages(pages, range_bytes=range_bytes)) == want(ROWS)


def test_query_and_empty_table(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/full/pages.parquet")
    assert got(op12_warc(spark, f"{tmp_path}/full")) == want(ROWS)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert op12_warc(spark, f"{tmp_path}/none").count() == 0


def test_archive_is_gzip_of_whole_records(spark, tmp_path):
    path = f"{tmp_path}/archive"
    warc.write_archive(warc.page_records(spark.createDataFrame(ROWS, SCHEMA).coalesce(1)), path, file_bytes=2_000)
    files = sorted((tmp_path / "archive").glob("*.warc.gz"))
    assert len(files) > 1 and not list((tmp_path / "archive").glob(".*.warc.gz"))
    text = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == len(ROWS) and b"WARC-Target-URI: http://a/%C3%A4%20b%0D%0AX:%20y\r\n" in text
    rows = warc.read_archive(spark, path, range_bytes=600, payload=True).collect()
    assert all(hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest[7:] for r in rows if r.record_type == "response")
    assert sorted(r.record_type for r in rows).count("revisit") == sum(w[3] == "revisit" for w in want(ROWS))


def member(kind: str, page: str, payload: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(warc.record_bytes(page, kind, "http://x", "1970-01-01T00:00:00Z", hashlib.sha256(payload).hexdigest(), None, payload, len(payload))) + packer.flush()


@pytest.mark.parametrize("level", [0, 6])
def test_archives_inside_payloads_give_no_records(spark, tmp_path, level):
    inner = b"".join(member("response", f"urn:page:{100 + i}:0", b"inner" * 40, 9) for i in range(30))
    noise = random.Random(2).randbytes(3_000) + warc.MAGIC * 50
    whole = [member("response", f"urn:page:{i}:0", body, level) for i, body in enumerate([b"a" * 500, noise + inner + noise, b"", inner, b"b" * 300])]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(whole))
    for step in (64, 500, 2_000, 1 << 20):
        rows = warc.read_archive(spark, f"file://{tmp_path}", range_bytes=step).collect()
        assert sorted(r.record_id for r in rows) == [f"urn:page:{i}:0" for i in range(5)], step


def test_tasks_own_what_starts_inside():
    data = b"junk" + b"".join(member("response", str(i), bytes([i]) * i * 7, 6) for i in range(40)) + b"more junk \x1f\x8b"
    everything = [r["record_id"] for r in warc.records_in(io.BytesIO(data), len(data), 0, len(data), False)]
    assert everything == [str(i) for i in range(40)]
    for step in (1, 3, 50, 333):
        parts = [r["record_id"] for a in range(0, len(data), step) for r in warc.records_in(io.BytesIO(data), len(data), a, min(a + step, len(data)), False)]
        assert parts == everything


def test_broken_records_raise(spark, tmp_path):
    data = member("response", "urn:page:1:0", b"good " * 100, 6) + member("response", "urn:page:2:0", random.Random(3).randbytes(5_000), 6)[:-900]
    (tmp_path / "x.warc.gz").write_bytes(data)
    with pytest.raises(Exception, match="broken record"):
        warc.read_archive(spark, str(tmp_path)).agg(F.count("whole"), F.sum(F.col("whole").cast("int"))).collect()


def test_failed_writes_leave_nothing(spark, tmp_path):
    records = warc.page_records(spark.createDataFrame(ROWS, SCHEMA))
    bad = records.withColumn("payload_bytes", F.when(F.col("record_id").contains(":15:"), F.raise_error(F.lit("no"))).otherwise(F.col("payload_bytes")).cast("long"))
    with pytest.raises(Exception, match="no"):
        warc.write_archive(bad, f"{tmp_path}/archive")
    (tmp_path / "archive").mkdir(exist_ok=True)
    assert warc.read_archive(spark, f"{tmp_path}/archive").count() == 0

