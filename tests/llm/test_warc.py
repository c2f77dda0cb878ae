"""WARC round trips."""

import gzip
import hashlib
import os
from collections import Counter

import pytest

from quillfund.llm import warc
from quillfund.llm.common import scratch_path
from quillfund.llm.warc import read_archives, read_pages, resolve, write_archives

PAGES = "page_id long, url string, html string, payload_bytes string"


def pages():
    long = "<p>é</p>" * 40
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\nContent-Length: 3\r\n\r\n" * 5
    rows = [(5, "http://a/ b\r\nX: y", long), (3, None, long), (9, "u", long), (9, "u", long), (None, "u", long), (3, "again", long)]
    rows += [(1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", tricky), (8, "u", tricky), (10, "u", "\r\n\r\n" * 30), (11, "u", "x\r\n\r\n"), (12, "u", "z" * 300_000)]
    return [(*r, "clash") for r in rows]


def expected(rows):
    out = Counter()
    for page, _, html, _ in rows:
        data = (html or "").encode()
        same = [r[0] for r in rows if r[2] == html and r[0] is not None]
        revisit = page is not None and len(data) >= 100 and page > min(same)
        out[page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None] += 1
    return out


@pytest.mark.parametrize("bound", [None, -1])
def test_round_trip(spark, bound):
    path = scratch_path(spark, "warc")
    write_archives(spark.createDataFrame(pages(), PAGES), path, bound=bound)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_pages(spark, path).collect())
    assert got == expected(pages())
    stored = [r for r in read_archives(spark, path).collect() if r.headers["warc-type"] == "revisit"]
    assert stored and all(bytes(r.block).endswith(b"\r\n\r\n") and len(r.block) < 100 for r in stored)


@pytest.mark.parametrize("file_records", [20_000, 1])
def test_any_ending_round_trips(spark, monkeypatch, file_records):
    monkeypatch.setattr(warc, "FILE_RECORDS", file_records)
    endings = ["\r\n" * k for k in range(6)] + ["\r", "\n", "\r\n\r", "\n\r\n", "\r\r\n"]
    rows = [(10 * j + k, "u", start + ending, "clash") for j, start in enumerate(["", "x", "y" * 120, "\r\n\r\nz"]) for k, ending in enumerate(endings)]
    rows += [(row[0] + 1000, *row[1:]) for row in rows]
    path = scratch_path(spark, "warc")
    write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), path)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_pages(spark, path).collect())
    assert got == expected(rows)


def test_refuses_records_longer_than_they_say(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nx\r\n\r\ny\r\n\r\n"))
    with pytest.raises(Exception, match="longer than"):
        read_archives(spark, str(tmp_path)).collect()


def test_reads_other_writers_and_refuses_cut_files(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 5\r\n\r\n\xff\r\n\r\n\r\n\r\n"
    empty = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    os.makedirs(tmp_path / "good")
    (tmp_path / "good" / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(empty) + gzip.compress(record))
    got = [(r.headers["warc-type"], bytes(r.block)) for r in read_archives(spark, str(tmp_path / "good")).collect()]
    assert got == [("resource", b"\xff\r\n\r\n"), ("metadata", b""), ("resource", b"\xff\r\n\r\n")]
    os.makedirs(tmp_path / "cut")
    (tmp_path / "cut" / "a.warc.gz").write_bytes(gzip.compress(record[:-7]))
    with pytest.raises(Exception, match="cut short"):
        read_archives(spark, str(tmp_path / "cut")).collect()


def test_reads_plain_archives_of_many_splits(spark, tmp_path):
    record = lambda k: b"WARC/1.0\r\nWARC-Type: resource\r\nX-Page-Id: %d\r\nContent-Length: 3000\r\n\r\n" % k + bytes([65 + k % 26]) * 2996 + b"\r\n\r\n\r\n\r\n"
    for name in "ab":
        (tmp_path / f"{name}.warc").write_bytes(b"".join(record(k) for k in range(300)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = read_archives(spark, str(tmp_path))
        got = Counter((int(r.headers["x-page-id"]), bytes(r.block[:1]), len(r.block)) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == Counter({(k, bytes([65 + k % 26]), 3000): 2 for k in range(300)})


def test_empty_table(spark):
    empty = spark.createDataFrame([], PAGES)
    assert resolve(empty).count() == 0
    path = scratch_path(spark, "warc")
    write_archives(empty, path)
    assert read_pages(spark, path).count() == 0
