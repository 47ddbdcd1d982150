import base64
import gzip
import hashlib
import pathlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from odd import no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F

from eventloom.llm import warc
from eventloom.llm.common import staged

PAGES = [
    (5, "http://a/", "<p>same</p>"),
    (3, "http://b/\r\nX: y", "<p>same</p>"),
    (4, None, "<p>same</p>"),
    (None, "http://n/", "<p>same</p>"),
    (None, "http://n/", "<p>only here</p>"),
    (6, "http://c/", None),
    (7, "http://d/", ""),
    (8, "http://long/", "äöü😀 WARC/1.1\r\n0\r\n\r\n" * 9000),
    (9, "http://long2/", "äöü😀 WARC/1.1\r\n0\r\n\r\n" * 9000),
    (10, "http://twice/", "x" * 70_000),
    (10, "http://twice/", "x" * 70_000),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(pages, least=0):
    first = {}
    for page_id, _, html in pages:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    out = []
    for page_id, _, html in pages:
        size = len((html or "").encode())
        answer = first.get(html or "") if size >= least else page_id
        revisit = answer is not None and page_id != answer
        out.append((str(page_id), size, digest(html), "revisit" if revisit else "response", str(answer) if revisit else None))
    return sorted(out, key=str)


def run(spark, pages, path, **options):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS first_id", "3 AS same")
    warc.write_archives(df, path, **options)
    records = staged(warc.read_records(spark, path), "records")
    found = warc.captures(records).collect()
    assert all(r.error is None for r in found)
    return records, sorted([(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found], key=str)


@pytest.mark.parametrize("least", [0, 12])
def test_pages_come_back(spark, tmp_path, least):
    records, found = run(spark, PAGES, f"{tmp_path}/w", min_bytes=least, segment_bytes=4000)
    assert found == brute(PAGES, least)
    whole = {r.page_id: bytes(r.payload) for r in warc.payloads(warc.reassembled(records)).collect()}
    assert whole["8"].decode() == PAGES[7][2]
    assert records.filter("kind = 'continuation'").count() > 20


def test_archives_are_plain_gzip_members(spark, tmp_path):
    run(spark, PAGES, f"{tmp_path}/w")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in pathlib.Path(f"{tmp_path}/w").glob("part-*"))
    assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
    assert data.count(b"WARC-Type: response") == 6
    uncompressed = list(warc.parse(data))
    assert all(r["error"] is None for r in uncompressed) and len(uncompressed) > len(PAGES)


def test_query_over_the_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = warc.op4_warc_segments(spark, "/root/testdata/sf0.001").collect()
    got = sorted([(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and str(r.refers_to)) for r in found], key=str)
    assert got == brute([(r.page_id, r.url, r.html) for r in pages.collect()])


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(df, f"{tmp_path}/w")
    assert warc.captures(staged(warc.read_records(spark, f"{tmp_path}/w"), "records")).count() == 0


def test_damaged_segments_are_reported(spark, tmp_path):
    records, _ = run(spark, PAGES[7:8], f"{tmp_path}/w", segment_bytes=50_000)
    last = records.agg(F.max("segment")).first()[0]
    assert last > 3
    for condition, want in (
        ("segment <> 2", "missing segment"),
        (f"segment <> {last}", "no last segment"),
        ("segment <> 1", "missing segment"),
    ):
        (row,) = warc.payloads(warc.reassembled(staged(records.filter(condition), "cut"))).collect()
        assert row.payload is None and row.error == want
    short = records.withColumn("block", F.expr("CASE WHEN segment = 2 THEN substring(block, 1, 10) ELSE block END"))
    (row,) = warc.payloads(warc.reassembled(staged(short, "cut"))).collect()
    assert row.payload is None and row.error == "length differs from the total"


@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunk_framing(body, size):
    assert warc.unchunked(warc.chunked(body, size)) == body


@pytest.mark.parametrize("bad", [b"", b"5\r\nabc", b"3\r\nabcX0\r\n\r\n", b"zz\r\n", b"3\r\nabc\r\n", b"0\r\nx"])
def test_damaged_framing_is_refused(bad):
    with pytest.raises(ValueError):
        warc.unchunked(bad)


@pytest.mark.parametrize("data", [b"", gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nabc"), gzip.compress(b"abc")[:-5], b"no archive"])
def test_damaged_archives_do_not_crash(data):
    rows = list(warc.parse(data))
    assert [r["kind"] for r in rows] == (["damaged"] if data else [])
