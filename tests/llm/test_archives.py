"""ARC to WARC and back."""

import gzip
import hashlib

import pytest

from waymill.llm import archives

SCHEMA = "page_id long, url string, html string, date string, digest int"


def test_arc_lines_of_both_versions():
    for version, fields in ((1, 5), (2, 10)):
        body = b"line\nline\r\n\r\n" * 3
        head = archives.arc_header(version, "a.arc")
        record = archives.arc_record(version, "http://x/ab%", body, 7, "a.arc", len(head))
        assert len(record.split(b"\n")[0].split(b" ")) == fields
        for content in (head + record, gzip.compress(head) + gzip.compress(record)):
            (r,) = archives.read_arc(content)
            http, payload = archives.split_http(r.block)
            assert (r.url, r.date, r.ip, r.content_type, payload, archives.source_key(http), r.error) == ("http://x/ab%", "20000101000000", "0.0.0.0", "text/html", body, 7, None)
        assert [r.error is None for r in archives.read_arc((head + record)[:-5])] == [False]
        assert [r.error for r in archives.read_arc(record)] == [None]  # without its first record
    mixed = archives.arc_header(2, "a") + archives.arc_record(1, None, b"", None, "a", 0)
    assert [r.error is None for r in archives.read_arc(mixed)] == [False]


def test_foreign_records():
    v1 = archives.arc_header(1, "a.arc")
    v2 = archives.arc_header(2, "a.arc")
    line = lambda text, block: text.encode() + b" %d\n" % len(block) + block + b"\n"
    ok = b"HTTP/1.0 200 OK\r\n\r\nbody"
    records = list(archives.read_arc(
        v1 + line("http://x/a b%2Fc%zz 100% 1.2.3.4 20010203040506 text/html; charset=utf-8", ok)
        + line("dns:x 1.2.3.4 2001 text/dns", b"x. 1 IN A 1.2.3.4")
        + line("http://x/ 1.2.3.4 20010231 text/html", ok)
        + b"garbage\nmore garbage\n\n" + line("http://y/ - 20010203 -", ok)
    ))
    assert [(r.url, r.content_type, r.error is None) for r in records] == [
        ("http://x/a b%2Fc%zz 100%", "text/html; charset=utf-8", True), ("dns:x", "text/dns", True), ("http://x/", "text/html", False), (None, "-", False), ("http://y/", "-", True)
    ]
    right, wrong = hashlib.md5(b"body").hexdigest(), "0" * 32
    records = list(archives.read_arc(v2 + line(f"http://x/ 1.2.3.4 20010203 text/html; x=y 302 {right} http://z/ 0 a.arc", ok) + line(f"http://x/ 1.2.3.4 20010203 text/html 200 {wrong} - 0 a.arc", ok)))
    assert [(r.content_type, r.result_code, r.location, r.error) for r in records] == [("text/html; x=y", 302, "http://z/", None), ("text/html", 200, None, "checksum of other bytes")]


def test_damaged_records_are_rows_and_fail_nothing(spark):
    ok = b"HTTP/1.0 200 OK\r\n\r\nbody"
    content = archives.arc_header(1, "a") + b"http://x/%%2F 1.2.3.4 20010203 text/html %d\n" % len(ok) + ok + b"\nnoise\ndns:x 1.2.3.4 2001 text/dns 3\nabc\nhttp://y/ 1.2.3.4 20010203 text/html 99\ncut"
    parsed = archives.parse_arc(spark.createDataFrame([("a", bytearray(content)), ("b", bytearray(b""))], archives.ARCHIVES))
    assert [(r["url"], r["error"] is None) for r in parsed.collect()] == [("http://x/%2F", True), (None, False), ("dns:x", True), ("http://y/", False)]
    read = {r["target_uri"]: r for r in archives.parse_warc(archives.to_warc(parsed)).collect()}
    assert {u: (r["record_type"], bytes(r["payload"])) for u, r in read.items()} == {"http://x/%2F": ("response", b"body"), "dns:x": ("resource", b"abc")}


def test_a_revisit_without_a_length(spark):
    record = archives.warc_record("revisit", "http://x/", "2001", "1.2.3.4", b"HTTP/1.1 200 OK\r\nX-Content-Length: 9\r\n\r\n", b"body", "<urn:uuid:1>")
    (row,) = archives.parse_warc(spark.createDataFrame([("a", bytearray(record))], archives.ARCHIVES)).collect()
    assert row["payload_bytes"] is None and row["payload_digest"] == hashlib.sha1(b"body").hexdigest()


def test_dates_and_damage():
    assert archives.warc_date("20010203040506") == "2001-02-03T04:05:06Z" and archives.warc_date("2001") == "2001-01-01T00:00:00Z" and archives.warc_date("20010231") is None
    record = archives.warc_record("response", "http://x/", "20010203", "1.2.3.4", b"HTTP/1.1 200 OK\r\n\r\n", b"body", None)
    (headers, block), = archives.read_warc(record)
    assert headers["warc-type"] == "response" and headers["warc-date"] == "2001-02-03T00:00:00Z" and block.endswith(b"body")
    with pytest.raises(ValueError):
        list(archives.read_warc(gzip.compress(gzip.decompress(record).replace(b"body", b"bodz"))))


def test_round_trip(spark):
    big, bigger = "é" * 600, "z" * 300_000
    rows = [(1, "http://a/", big), (5, "http://b/ c", big), (3, None, big), (4, "http://d", "small"), (6, "http://e", "small"), (7, "", None), (8, "http://f", bigger), (9, "g", bigger), (10, "h", "a\r\n\r\nb\0"), (None, "i", "no key"), (11, "j", "x" * 1000), (12, "k", "x" * 1000), (13, "l", "x" * 999), (14, "m", "x" * 999)]
    df = spark.createDataFrame([(*r, "d", 1) for r in rows], SCHEMA)
    got = {r["page_id"]: tuple(r)[1:] for r in archives.round_trip(df).collect()}
    best = {big: 5, bigger: 9, "x" * 1000: 12}
    for key, _, html in rows:
        data = (html or "").encode()
        target = best.get(html)
        revisit = target is not None and target != key
        assert got[key] == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", target if revisit else None)
    assert len(got) == len(rows)
    assert archives.round_trip(df.limit(0)).collect() == []
    again = archives.round_trip(df.where("page_id = 5").union(df.where("page_id = 5"))).collect()
    assert [r["record_type"] for r in again] == ["response"] * 2
    records = archives.parse_warc(archives.convert(df)).collect()
    assert {r["target_uri"] for r in records} >= {"http://b/ c", None} and sum(r["payload"] is None for r in records) == 4
