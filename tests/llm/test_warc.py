from __future__ import annotations

import gzip
import hashlib
import io

import pytest

from snipmill.llm import warc
from snipmill.session import new_folder

PAGES = "page_id long, url string, html string"


def archive(spark, rows):
    folder = new_folder(spark, "archives")
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    return warc.read_archives(warc.archive(pages, folder), folder).collect()


def test_records_equal_brute_force(spark):
    long = "<p>é</p>" * 40
    rows = [(9, "http://a/ b\n", long), (3, "http://b/", long), (4, None, long), (5, "u", None), (6, "u", ""), (7, "u", "short"),
            (8, "u", "short"), (10, "u", "x" * 3_000_000), (11, "u", "y\r\n\r\nWARC/1.1\r\n" * 30), (2, "u", "z" * 100), (1, "u", "z" * 100),
            (12, "u", "z" * 99), (13, "u", "z" * 99), *[(100 + i, "u", "copy" * 50) for i in range(200)]]
    found = {r.page_id: r for r in archive(spark, rows)}
    assert len(found) == len(rows)
    for page, _, html in rows:
        data = (html or "").encode()
        first = min(p for p, _, h in rows if (h or "").encode() == data)
        again = len(data) >= 100 and first != page
        r = found[page]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first) if again else ("response", None))
    assert found[9].target_uri == "http://a/%20b%0A" and found[4].target_uri == "unknown:"


def test_ids_that_are_null_or_repeat_and_an_empty_table(spark):
    long = "x" * 200
    rows = archive(spark, [(None, "u", long), (5, "u", long), (5, "u", long), (None, "u", "s")])
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in rows if r.payload_bytes == 200) == [
        (0, "revisit", 5), (5, "response", None), (5, "revisit", 5)]
    folder = new_folder(spark, "archives")
    assert warc.read_archives(warc.archive(spark.createDataFrame([], PAGES), folder), folder).collect() == []


def arc(version, lines):
    data = warc.arc_version_block(version, "20010203040506")
    return io.BytesIO(data + b"".join(lines))


def test_both_versions_are_read_by_their_fields_and_lengths():
    body = b"HTTP/1.0 200 OK\r\n\r\nhttp://x 1.1.1.1 2001 text/html 3\nabc"
    one = list(warc.read_arc(arc(1, [b"http://a b/ 1.2.3.4 20010203 text/html %d\n" % len(body), body, b"\n", b"http://c 1.2.3.4 2001 - 0\n\n"])))
    assert [(f["url"], f["date"], c) for f, c in one] == [("http://a b/", "20010203", body), ("http://c", "2001", b"")]
    two = list(warc.read_arc(arc(2, [b"http://a 1.2.3.4 20010203040506 text/html 404 abc - 77 f.arc %d\n" % len(body), body, b"\n"])))
    assert (two[0][0]["status"], two[0][0]["offset"], two[0][1]) == ("404", "77", body)


@pytest.mark.parametrize("data", [
    b"http://c 1.2.3.4 2001 text/html 0\n\n", b"filedesc://x 0 2001 text/plain 5\n9 0 c\n\n",
    warc.arc_version_block(1, "2001") + b"http://c 1.2.3.4 2001 text/html 10\nabc\n", warc.arc_version_block(1, "2001") + b"no header\n"])
def test_damaged_archives_are_errors(data):
    with pytest.raises(warc.Damaged):
        list(warc.read_arc(io.BytesIO(data)))


def test_dates_and_identifiers():
    assert warc.iso_date("20010203040506") == "2001-02-03T04:05:06Z"
    assert warc.iso_date("2001") == "2001-01-01T00:00:00Z"
    assert warc.iso_date("x") == warc.iso_date("20019999") == "1970-01-01T00:00:00Z"
    assert warc.record_id("a#1") == warc.record_id("a#1") != warc.record_id("a#2")


def test_members_are_plain_gzip():
    data = [b"", b"a" * 5_000_000, b"end"]
    packed = b"".join(map(warc.packed, data))
    assert gzip.decompress(packed) == b"".join(data)
    assert io.BufferedReader(warc.Members(io.BytesIO(packed))).read() == b"".join(data)
