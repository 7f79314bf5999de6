"""Archives written, converted and read back: both ARC versions, odd headers, damage, revisits."""

import hashlib
import io
import gzip

import pytest
from pyspark.sql import functions as F

from areapanel.llm import warc
from areapanel.operators.scale import scratch_path

LONG = "é" * 600
ROWS = [(1, "http://a.example/x", LONG), (5, "http://b.example/y z\n", LONG), (3, "http://a.example/x", LONG), (9, None, None), (10, "", ""), (11, "https://c.example", "short"), (12, "u", "short"),
        (None, "http://n.example", LONG), (5, "http://b.example/again", LONG), (20, "http://d.example", "\r\n\r\nWARC/1.1\r\n\n1 0 x\n" * 80), (21, "http://e.example", "x" * 300_000),
        (None, "http://m.example", "only without number " * 60), (None, "http://m.example", "only without number " * 60)]


def brute(rows):
    out, groups = [], {}
    for n, (i, _, html) in enumerate(rows):
        groups.setdefault(html or "", []).append((i is not None, i or 0, n))
    for n, (i, _, html) in enumerate(rows):
        payload = (html or "").encode()
        keep = max(groups[html or ""])
        again = len(payload) >= 1000 and (i is not None, i or 0) < keep[:2]
        out.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", keep[1] if again and keep[0] else None))
    return out


@pytest.mark.parametrize("segment", [warc.SEGMENT_BYTES, 2000])
def test_pages_equal_brute_force(spark, segment):
    rows = [r for n, r in enumerate(ROWS) if n not in (8, 12)]  # repeated ones are below
    pages = spark.createDataFrame([(*r, "p", 7) for r in rows], "page_id long, url string, html string, path string, number int").repartition(3)
    got = warc.archived_pages(pages, segment_bytes=segment)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


def test_of_repeated_rows_one_is_the_response(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(4)
    got = warc.archived_pages(pages).collect()
    assert len(got) == len(ROWS)
    kept = [r for r in got if r.payload_digest == hashlib.sha1(LONG.encode()).hexdigest()]
    assert sorted(str((r.page_id, r.record_type, r.refers_to)) for r in kept) == sorted(
        str(x) for x in [(1, "revisit", 5), (3, "revisit", 5), (None, "revisit", 5), (5, "revisit", 5), (5, "response", None)])
    unnumbered = [r.record_type for r in got if r.payload_bytes == 1200 and r.page_id is None and r not in kept]
    assert sorted(unnumbered) == ["response", "revisit"]


def test_a_payload_that_a_third_of_the_pages_share(spark):
    rows = [(n, f"http://h.example/{n}", LONG if n % 3 == 0 else f"{n} " * 400) for n in range(600)]
    got = warc.archived_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), segment_bytes=20_000)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived_pages(empty).count() == 0




def arc(header, *records, version=b"1"):
    body = version + b" 0 crawler\n" + header + b"\n"
    more = b" 200 - - 0 old.arc" if version == b"2" else b""
    return b"filedesc://old.arc 0.0.0.0 19970131000000 text/plain" + more + b" %d\n" % len(body) + body + b"\n" + b"\n".join(records)


def test_header_lines_of_both_versions():
    first = arc(warc.ARC_FIELDS[1].encode(), b"http://a/with blank 1.2.3.4 19980203040506 text/html 5\nhello\n", b"dns:a 1.2.3.4 19980203 text/dns 2\n\n\n\n")
    second = arc(warc.ARC_FIELDS[2].encode(), b"http://b/ ::1 1998020304 text/html 404 abc http://c/ 77 old.arc 3\nxyz\n", version=b"2")
    odd = arc(b"URL Archive-date Archive-length", b"http://d/ 199802 1\nq\n")
    found = [[(r["URL"], r["block"], r.get("Archive-date")) for r in warc.arc_records(a)][1:] for a in (first, second, odd)]
    assert found == [[("http://a/with blank", b"hello", "19980203040506"), ("dns:a", b"\n\n", "19980203")], [("http://b/", b"xyz", "1998020304")], [("http://d/", b"q", "199802")]]
    assert [x["Archive-date"] for x in warc.arc_records(second)][0] == "19970131000000"


def test_dates_types_and_digests():
    assert [warc.iso_date(x) for x in ("19980203040506", "1998020304", "19980230", "x")] == ["1998-02-03T04:05:06Z", "1998-02-03T04:00:00Z", warc.EPOCH, warc.EPOCH]
    base = {"offset": 0, "IP-address": "1.2.3.4", "Archive-date": "bad", "truncated": False}
    http = warc.capture(base | {"URL": "http://a", "Content-type": "text/html", "block": b"HTTP/1.0 200 OK\nA: b\n\nbody"}, "p", "1997-01-01T00:00:00Z")
    assert (http["warc_type"], http["payload"], http["warc_date"], http["content_type"]) == ("response", b"body", "1997-01-01T00:00:00Z", "application/http; msgtype=response")
    dns = warc.capture(base | {"URL": "dns:a", "Content-type": "text/dns", "block": b"a 1.2.3.4"}, "p", warc.EPOCH)
    assert (dns["warc_type"], dns["content_type"], dns["payload"]) == ("resource", "text/dns", b"a 1.2.3.4")
    old = warc.capture(base | {"URL": "http://a", "Content-type": "no-type", "block": b"<p>"}, "p", warc.EPOCH)
    assert (old["warc_type"], old["content_type"]) == ("resource", "application/octet-stream")
    text = warc.warc_of(http, None)
    assert b"WARC-Payload-Digest: " + warc.sha1_label(hashlib.sha1(b"body").digest()).encode() in text and text.endswith(b"body\r\n\r\n")
    assert http["record_id"] != warc.capture(base | {"URL": "http://a", "offset": 9, "block": b""}, "p", warc.EPOCH)["record_id"]


def test_damage_is_reported_and_the_rest_is_kept(spark):
    good = b"http://a/ 1.2.3.4 19980203040506 text/html 5\nhello\n"
    folder = scratch_path(spark, "damaged")
    files = {"cut": arc(warc.ARC_FIELDS[1].encode(), good, b"http://b/ 1.2.3.4 19980203040506 text/html 50\nshort"),
             "noise": arc(warc.ARC_FIELDS[1].encode(), good, b"what is this\n"), "empty": b"", "other": b"\x00\xff" * 50,
             "halved": gzip.compress(arc(warc.ARC_FIELDS[1].encode(), good)) + gzip.compress(b"x" * 5000)[:20]}
    rows = [(bytearray(v),) for v in files.values()]
    warc._write(spark.createDataFrame(rows, "value binary"), folder)
    index = warc.convert(spark, folder, out := scratch_path(spark, "warc"))
    told = [(r.error is not None, r.target_uri, r.truncated) for r in index.collect()]
    assert sorted(map(str, told)).count(str((False, "http://a/", False))) == 3 and (False, "http://b/", True) in told and sum(t[0] for t in told) >= 2
    read = warc.read_warc(spark, out).collect()
    assert sorted(r.target_uri for r in read) == ["http://a/"] * 3 + ["http://b/"] and all(r.digest_ok and not r.error for r in read)


def test_files_are_plain_gzip_with_a_member_per_record(spark, tmp_path):
    pages = spark.createDataFrame([(n, f"http://a/{n}", f"page {n}") for n in range(4)], "page_id long, url string, html string").coalesce(1)
    warc.write_arc(warc.page_captures(pages), str(tmp_path / "arc"), version=2)
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    (file,) = (tmp_path / "warc").glob("part-*")
    raw = file.read_bytes()
    assert raw.count(b"\x1f\x8b\x08") >= 5
    text = gzip.GzipFile(fileobj=io.BytesIO(raw)).read()
    assert text.count(b"WARC/1.1\r\n") == 5 and text.count(b"WARC-Type: response") == 4 and text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_changed_bytes_are_noticed():
    made = warc.capture({"URL": "http://a", "offset": 0, "Content-type": "t/h", "IP-address": "-", "Archive-date": "", "truncated": False, "block": b"HTTP/1.1 200 OK\r\n\r\nbody"}, "p", warc.EPOCH)
    raw = warc.warc_of(made, None)
    rows = [warc._read_row("f", next(warc.warc_records(x))) for x in (raw, raw.replace(b"body", b"bodi"))]
    assert [r["digest_ok"] for r in rows] == [True, False]


def test_query_equals_sql(spark, sf):
    from areapanel.llm.queries import QUERIES, SQL
    from oracle import compare, connect

    assert compare(QUERIES["op13_warc"](spark, sf), connect(sf), SQL["op13_warc"]) is None
