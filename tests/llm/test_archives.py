from __future__ import annotations

import base64
import hashlib

import pytest

from tableview.llm import archives

PAGES = "page_id long, url string, html string, type string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(pages, least=0):
    first = {}
    for page, _, html, *_ in pages:
        if page is not None:
            first[digest(html)] = min(page, first.get(digest(html), page))
    rows = []
    for page, _, html, *_ in pages:
        size, own = len((html or "").encode()), first.get(digest(html))
        repeat = size >= least and own is not None and page != own
        kind = "revisit" if repeat else "response"
        rows.append((page, size, digest(html), kind, own if repeat else None))
    return sorted(rows, key=str)


CASES = [
    (5, "http://a/ b c", "<p>é</p>", "x"),
    (3, "http://b/", "<p>é</p>", None),
    (4, None, None, None),
    (7, "http://c/", "", None),
    (8, "http://d/", "WARC/1.0\r\n\r\n\n\nhttp://x 0.0.0.0 2 text/html 3\n", None),
    (9, "http://e/", "y" * 300_000, None),
    (None, "http://f/", "<p>é</p>", None),
    (None, "http://g/", "alone", None),
    (3, "http://b/", "<p>é</p>", None),
]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    frame = spark.createDataFrame(CASES, PAGES)
    found = archives.round_trip(frame, least).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
    assert sorted((tuple(row) for row in found.collect()), key=str) == brute(CASES, least)


def test_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = archives.round_trip(pages).collect()
    assert sorted(map(tuple, found), key=str) == brute(pages.collect())


def test_both_versions_are_read():
    for version in (1, 2):
        bodies = [b"HTTP/1.0 200 OK\n\nhello\n\n", b"", b"dns text"]
        records = [(f"http://h/{i} x", "19990102030405", "text/html", b) for i, b in enumerate(bodies)]
        content = archives.arc_file("a.arc", version, records)
        found = list(archives.read_arc("a.arc", content))
        assert [record.body for record in found] == bodies
        assert [record.url for record in found] == [f"http://h/{i}%20x" for i in range(3)]
        assert archives.iso_date(found[0].date) == "1999-01-02T03:04:05Z"
        cut = list(archives.read_arc("a.arc", content[:-4]))
        assert cut[-1].truncated and cut[-1].body == b"dns t"
    with pytest.raises(ValueError):
        list(archives.read_arc("b.arc", b"nonsense\n"))


def test_dates_and_ids():
    assert archives.iso_date("1999") == "1999-01-01T00:00:00Z"
    assert archives.iso_date("") == "0000-01-01T00:00:00Z"
    assert archives.record_id("a", 1) == archives.record_id("a", 1) != archives.record_id("a", 2)


def test_empty_table(spark):
    assert archives.round_trip(spark.createDataFrame([], PAGES)).count() == 0
