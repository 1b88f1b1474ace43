"""ARC to WARC against the rules, and the two header layouts."""

import hashlib

import pytest

from faultline.llm import arc
from faultline.session import scratch


def test_round_trip(spark):
    big, other = "é" * 700, "z" * 999
    given = [(1, "http://a/b c", big), (2, "http://a/é", big), (3, None, None), (4, "", other), (5, "http://b", other), (6, "http://c", "x\r\n\r\ny" * 300),
             (7, "http://d", big), (None, "http://n", big), (7, "http://d", big)]
    pages = spark.createDataFrame([(*r, 1, "k") for r in given], "page_id long, url string, html string, key long, archive string").repartition(3)
    rows = arc.round_trip(pages, scratch(spark, "archives")).collect()
    assert len(rows) == len(given)
    for page, _, html in given:
        data = (html or "").encode()
        newest = html == big and page != 7
        mine = [r for r in rows if r.page_id == page]
        assert all(r.payload_bytes == len(data) and r.payload_digest == hashlib.sha1(data).hexdigest() for r in mine)
        if page != 7:
            assert [(r.record_type, r.refers_to) for r in mine] == [("revisit", 7) if newest else ("response", None)]
    assert sorted(r.record_type for r in rows if r.page_id == 7) == ["response", "revisit"]


def test_both_versions():
    body = b"HTTP/1.1 200 OK\r\n\r\nhello\n\nworld"
    for version in (1, 2):
        head, described = arc.parse_record(arc.description(version, "f.arc", arc.DATE), None)
        assert arc.version_of(described) == version and head["URL"] == "filedesc://f.arc"
        fields, found = arc.parse_record(arc.arc_record(version, "http://a/", "20010203040506", "text/html", body, 404, "f.arc", 99), version)
        assert found == body and fields["URL"] == "http://a/" and list(fields) == arc.FIELDS[version]
        record = arc.to_warc(fields, found, {"record_id": "<urn:uuid:1>", "digest": arc.sha1(b"hello\n\nworld"), "to_id": None, "to_key": None})
        headers, block = arc.parse_warc(record)
        assert headers["WARC-Type"] == "response" and headers["WARC-Date"] == "2001-02-03T04:05:06Z" and block == body


def test_broken_records():
    with pytest.raises(ValueError, match="header line"):
        arc.parse_record(b"http://a/ 0.0.0.0 text/html\nx\n", 1)
    with pytest.raises(ValueError, match="of 50 bytes"):
        arc.parse_record(b"http://a/ 0.0.0.0 20010203040506 text/html 50\nx\n", 1)
    with pytest.raises(ValueError, match="version"):
        arc.version_of(b"3 0 x")


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert arc.round_trip(pages, scratch(spark, "archives")).count() == 0
