"""Legacy archives (ARC, versions 1 and 2) to WARC.

An ARC file starts with a version block whose last line names the fields of its record headers; a header is one line that ends
with the declared length of the block. ``convert`` reads those lines and lengths and makes equivalent WARC records: identifiers,
timestamps, types and digests. Captures whose payload is held by another capture become revisits of it.

Archives are written as one row per file, each record a gzip member of its own, so any file system that Spark writes to
will do; the NUL byte that ends each file is padding, which gzip readers skip. Tasks hold one archive at a time, whose size
``segment_bytes`` bounds (a longer record has a file of its own).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areapanel.llm.common import ship
from areapanel.operators.scale import lookup_join, materialize, scratch_path

SEGMENT_BYTES = 32 * 1024 * 1024
LEVEL = 3  # of compression
NUMBER = "x-record-number"  # HTTP header that says which of several equal payloads is the one to keep: the largest

# Fixed values of the two formats: the field names of record headers, by version, and the revisit profile.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MISSING_URL = "urn:missing"
EPOCH = "1970-01-01T00:00:00Z"


def unzip(data: bytes) -> bytes:
    """The bytes of all gzip members, or ``data`` if it isn't compressed; of a damaged file what comes before the damage."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, source = io.BytesIO(), gzip.GzipFile(fileobj=io.BytesIO(data))
    try:
        while part := source.read1(1 << 20):
            out.write(part)
    except (EOFError, OSError, zlib.error):
        pass
    return out.getvalue()


def member(data: bytes, level: int) -> bytes:
    own = zlib.compressobj(level, zlib.DEFLATED, 31)
    return own.compress(data) + own.flush()


def plain_url(url: str | None) -> str:
    """A URL that fits into a header line."""
    return quote(url, safe="".join(map(chr, range(0x21, 0x7F)))) if url else MISSING_URL


def iso_date(digits: str, other: str = EPOCH) -> str:
    """YYYYMMDD[hh[mm[ss]]] as WARC writes it; ``other`` if it isn't a date."""
    if not re.fullmatch(r"\d{8}(\d\d){0,3}", digits):
        return other
    try:
        return datetime.strptime(digits.ljust(14, "0"), "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return other


def split_http(block: bytes) -> tuple[dict[str, str], bytes, bytes] | None:
    """(headers by lower-case name, the header's bytes, payload) of an HTTP response; None if the block is no such thing."""
    if not block.startswith(b"HTTP/"):
        return None
    ends = [m for m in (block.find(b"\r\n\r\n"), block.find(b"\n\n")) if m >= 0]
    end = min(ends) if ends else len(block)
    size = 4 if block[end:end + 4] == b"\r\n\r\n" else 2
    fields = {}
    for line in block[:end].decode("latin-1").splitlines()[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return fields, block[:end + size], block[end + size:]


def whole_number(text: str | None) -> int | None:
    """The number a header gives; None for anything else, also for what no bigint can hold."""
    n = int(text) if text and re.fullmatch(r"-?\d{1,19}", text) else None
    return n if n is not None and -(1 << 63) <= n < 1 << 63 else None


def arc_records(data: bytes) -> Iterator[dict]:
    """Records of an ARC file, the version block first: ``offset``, the header's fields by name, ``block``, ``truncated``.

    Fields are read as the version block declares them. A URL may hold blanks: the other fields are counted from the
    right. A record that ends early has the bytes that are there and is marked. Where no header can be read, one record
    with ``error`` says so, and the rest of the file is left, because nothing tells where its records begin.
    """
    at, fields, version = 0, ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"], None
    while True:
        while data[at:at + 1] in (b"\n", b"\r", b"\0"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        line = data[at:end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        parts = line.rsplit(" ", len(fields) - 1)
        if end < 0 or len(parts) != len(fields) or not re.fullmatch("[0-9]{1,18}", parts[-1]):
            yield {"offset": at, "error": f"no record header: {line[:80]}"}
            return
        found = dict(zip(fields, parts)) | {"offset": at, "length": int(parts[-1])}
        block = data[end + 1:end + 1 + found["length"]]
        if version is None and line.startswith("filedesc:"):
            lines = block.decode("utf-8", "replace").split("\n")
            version, found["Archive-date"] = lines[0].split(" ")[0], line.split(" ")[2]  # this line may follow either version
            declared = lines[1].split() if len(lines) > 1 else []
            if declared and declared[0] == "URL" and declared[-1] in ("Archive-length", "Length"):
                fields = declared
        yield found | {"block": block, "truncated": len(block) < found["length"], "version": version}
        at = end + 1 + found["length"]


def capture(record: dict, path: str, opened: str) -> dict:
    """What becomes of an ARC record: type, identifier, date, payload and digests, by WARC's names."""
    url, block = record["URL"], record["block"]
    http = split_http(block) if url.lower().startswith(("http:", "https:")) or block.startswith(b"HTTP/") else None
    fields, head, payload = http or ({}, b"", block)
    own_type = record.get("Content-type", "")
    return {
        "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}#{record['offset']}')}>",
        "warc_type": "response" if http else "resource",
        "target_uri": plain_url(url), "warc_date": iso_date(record.get("Archive-date", ""), opened),
        "content_type": "application/http; msgtype=response" if http else own_type if "/" in own_type else "application/octet-stream",
        "ip": record.get("IP-address", ""), "number": whole_number(fields.get(NUMBER)), "head": head, "payload": payload,
        "payload_sha1": hashlib.sha1(payload).digest(), "truncated": record["truncated"],
    }


def sha1_label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def warc_of(made: dict, refers: dict | None) -> bytes:
    """The WARC record of a capture: as it is, or as a revisit that keeps the HTTP header and leaves the payload out."""
    block = made["head"] if refers else made["head"] + made["payload"]
    headers = [("WARC-Type", "revisit" if refers else made["warc_type"]), ("WARC-Record-ID", made["record_id"]),
               ("WARC-Date", made["warc_date"]), ("WARC-Target-URI", made["target_uri"])]
    if re.fullmatch(r"[0-9.]{7,15}|[0-9a-fA-F:]{3,39}", made["ip"]) and made["ip"] != "0.0.0.0":
        headers.append(("WARC-IP-Address", made["ip"]))
    headers += [("Content-Type", made["content_type"]), ("WARC-Payload-Digest", sha1_label(made["payload_sha1"])),
                ("WARC-Block-Digest", sha1_label(hashlib.sha1(block).digest()))]
    if refers:
        headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", refers["record_id"]),
                    ("WARC-Refers-To-Target-URI", refers["target_uri"]), ("WARC-Refers-To-Date", refers["warc_date"])]
    if made["truncated"]:
        headers.append(("WARC-Truncated", "length"))
    return warc_record(headers, block)


def warc_records(data: bytes) -> Iterator[dict]:
    """Records of a WARC file: header fields by lower-case name, ``offset``, ``block``; ``error`` where no record begins."""
    at = 0
    while True:
        while data[at:at + 1] in (b"\n", b"\r", b"\0"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at)
        fields = {}
        if data.startswith(b"WARC/", at) and end >= 0:
            for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
                name, _, value = line.partition(":")
                fields[name.strip().lower()] = value.strip()
        if not re.fullmatch("[0-9]{1,18}", fields.get("content-length", "")):
            yield {"offset": at, "error": f"no record header: {data[at:at + 80]!r}"}
            return
        size = int(fields["content-length"])
        yield fields | {"offset": at, "block": data[end + 4:end + 4 + size]}
        at = end + 4 + size


def _segments(records: Iterator[bytes], opening: bytes, segment_bytes: int) -> Iterator[pa.RecordBatch]:
    """One row per archive: the opening record and as many records as fit."""
    size, parts = 0, []
    for record in records:
        if parts and size + len(record) > segment_bytes:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join([opening, *parts])], pa.binary())], names=["value"])
            size, parts = 0, []
        parts.append(record)
        size += len(record)
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join([opening, *parts])], pa.binary())], names=["value"])


def _write(segments: DataFrame, path: str) -> str:
    """Each row of ``segments`` (value binary) as a file of its own."""
    segments.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    return path


def _archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "[!._]*").load(path).select("path", "content")


def write_arc(captures: DataFrame, path: str, version: int | None = None, segment_bytes: int = SEGMENT_BYTES, level: int = LEVEL) -> str:
    """Write (url, ip, archive_date, content_type, block) as ARC files of ``version``; None writes both versions, by turns.

    A null URL is written as urn:missing, a null block as empty; blanks and other signs that a header line can't hold are
    percent-encoded.
    """
    ship(captures.sparkSession)

    def run(batches):
        for number, batch in enumerate(batches):
            own = version or 1 + (TaskContext.get().partitionId() + number) % 2
            body = f"{own} 0 areapanel\n{ARC_FIELDS[own]}\n".encode()
            first = " ".join(["filedesc://areapanel.arc", "0.0.0.0", "19700101000000", "text/plain", *["200", "-", "-", "0", "areapanel.arc"] * (own == 2), str(len(body))])

            def lines(batch=batch, own=own):
                for row in batch.to_pylist():
                    block = row["block"] or b""
                    more = ["200", "-", "-", "0", "areapanel.arc"] * (own == 2)
                    head = " ".join([plain_url(row["url"]), row["ip"] or "0.0.0.0", row["archive_date"] or "-", row["content_type"] or "no-type", *more, str(len(block))])
                    yield member(head.encode() + b"\n" + block + b"\n", level)

            yield from _segments(lines(), member(first.encode() + b"\n" + body + b"\n", level), segment_bytes)

    return _write(captures.select("url", "ip", "archive_date", "content_type", "block").mapInArrow(run, "value binary"), path)


def arc_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the ARC files in ``path``, without payloads, and one with ``error`` for each place that can't be read.

    (path, offset, record_id, warc_type, target_uri, warc_date, number, payload_bytes, payload_sha256, truncated, error)
    """
    ship(spark)
    names = ["path", "offset", "record_id", "warc_type", "target_uri", "warc_date", "number", "payload_bytes", "payload_sha256", "truncated", "error"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.string()]

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = [_index_row(file, r, made) for r, made in _captures(file, content.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names=names)

    return _archives(spark, path).mapInArrow(
        run, "path string, offset long, record_id string, warc_type string, target_uri string, warc_date string, number long, "
        "payload_bytes long, payload_sha256 binary, truncated boolean, error string")


def _index_row(file: str, record: dict, made: dict | None) -> dict:
    if made is None:
        return {"path": file, "offset": record["offset"], "error": record["error"]}
    return made | {"path": file, "offset": record["offset"], "payload_bytes": len(made["payload"]),
                   "payload_sha256": hashlib.sha256(made["payload"]).digest()}


def _captures(file: str, content: bytes) -> Iterator[tuple[dict, dict | None]]:
    """Records with what becomes of them; None beside an error. The version block gives the date of undated records."""
    opened = EPOCH
    for record in arc_records(unzip(content)):
        if "error" in record:
            yield record, None
        elif record["URL"].startswith("filedesc:"):
            opened = iso_date(record.get("Archive-date", ""))
        else:
            yield record, capture(record, file, opened)


def revisits(index: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """(path, offset, refers): captures whose payload, of at least ``min_bytes``, another capture keeps.

    Of equal payloads the one with the largest ``number`` is kept; a null number is the smallest, and of equal numbers
    the last in order of path and offset is kept. A hot payload is one row on the side it is joined to.
    """
    held = index.filter(F.col("error").isNull() & (F.col("payload_bytes") >= min_bytes))
    place = F.struct(F.col("number").isNotNull(), "number", "path", "offset", "record_id", "target_uri", "warc_date")
    keepers = held.groupBy("payload_sha256", "payload_bytes").agg(F.max(place).alias("refers"), F.count(F.lit(1)).alias("n"))
    several = keepers.filter("n > 1").select("payload_sha256", "payload_bytes", "refers")
    found = lookup_join(held, several, ["payload_sha256", "payload_bytes"], "inner")
    return found.filter(F.col("record_id") != F.col("refers.record_id")).select(
        "path", "offset", F.struct("refers.record_id", "refers.target_uri", "refers.warc_date").alias("refers"))


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 1000, segment_bytes: int = SEGMENT_BYTES, level: int = LEVEL) -> DataFrame:
    """Convert the ARC files of a folder to WARC files in another, and return their index (see ``arc_index``).

    Every file begins with a warcinfo record that names the file it comes from. Records that can't be read are rows with
    ``error`` in the index and have no WARC record. The archives are read twice: once for digests, once to write.
    """
    index = materialize(arc_index(spark, arc_path))
    per_file = revisits(index, min_bytes).groupBy("path").agg(F.collect_list(F.struct("offset", "refers")).alias("revisits"))

    def run(batches):
        for batch in batches:
            for file, content, known in zip(batch.column("path").to_pylist(), batch.column("content"), batch.column("revisits")):
                refers = {x["offset"]: x["refers"] for x in known.as_py() or []}
                info = warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, file)}>"), ("WARC-Date", EPOCH),
                                    ("Content-Type", "application/warc-fields")], f"software: areapanel\r\nformat: WARC File Format 1.1\r\nsource: {file}\r\n".encode())
                records = (member(warc_of(made, refers.get(r["offset"])), level) for r, made in _captures(file, content.as_py()) if made)
                yield from _segments(records, member(info, level), segment_bytes)

    _write(lookup_join(_archives(spark, arc_path), per_file, ["path"]).mapInArrow(run, "value binary"), warc_path)
    return index


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files in ``path`` but for warcinfo, payloads left out, digests worked out anew.

    (path, offset, record_id, warc_type, target_uri, warc_date, number, payload_bytes, payload_digest, digest_ok, refers_to,
    error). A revisit's size and digest are those that its header states. ``payload_digest`` is hexadecimal.
    """
    ship(spark)
    names = ["path", "offset", "record_id", "warc_type", "target_uri", "warc_date", "number", "payload_bytes", "payload_digest", "digest_ok", "refers_to", "error"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = [_read_row(file, r) for r in warc_records(unzip(content.as_py())) if r.get("warc-type") != "warcinfo"]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names=names)

    return _archives(spark, path).mapInArrow(
        run, "path string, offset long, record_id string, warc_type string, target_uri string, warc_date string, number long, payload_bytes long, "
        "payload_digest string, digest_ok boolean, refers_to string, error string")


def _read_row(file: str, record: dict) -> dict:
    if "error" in record:
        return {"path": file, "offset": record["offset"], "error": record["error"]}
    fields, _, payload = split_http(record["block"]) or ({}, b"", record["block"])
    kind, label = record.get("warc-type"), record.get("warc-payload-digest", "")
    if kind == "revisit":
        stated = base64.b32decode(label.removeprefix("sha1:")).hex() if re.fullmatch("sha1:[A-Z2-7]{32}", label) else None
        size, digest = whole_number(fields.get("content-length")), stated
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    ok = record.get("warc-block-digest") == sha1_label(hashlib.sha1(record["block"]).digest()) and digest is not None and label == sha1_label(bytes.fromhex(digest))
    return {"path": file, "offset": record["offset"], "record_id": record.get("warc-record-id"), "warc_type": kind, "target_uri": record.get("warc-target-uri"),
            "warc_date": record.get("warc-date"), "number": whole_number(fields.get(NUMBER)), "payload_bytes": size, "payload_digest": digest,
            "digest_ok": ok, "refers_to": record.get("warc-refers-to")}


def page_captures(pages: DataFrame, date: str | Column = "20200101000000") -> DataFrame:
    """Captures of (page_id, url, html): an HTTP response each, whose header has the page's number and the payload's size.

    Null html is an empty payload; a null page_id leaves the number empty. Other columns are ignored.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Record-Number: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
                    F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.col("url").cast("string").alias("url"), F.lit("192.0.2.1").alias("ip"), (F.lit(date) if isinstance(date, str) else date).alias("archive_date"),
                        F.lit("text/html").alias("content_type"), F.concat(head.cast("binary"), payload).alias("block"))


def archived_pages(pages: DataFrame, min_bytes: int = 1000, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): pages written to ARC, converted, and read back from WARC.

    One row per row of ``pages``; of rows that repeat a page_id and a payload one is the response. A record whose digests
    don't match what was read raises an error.
    """
    spark = pages.sparkSession
    arc = write_arc(page_captures(pages), scratch_path(spark, "arc"), segment_bytes=segment_bytes)
    convert(spark, arc, warc_path := scratch_path(spark, "warc"), min_bytes, segment_bytes)
    read = materialize(read_warc(spark, warc_path))
    damaged = read.filter("error IS NOT NULL OR NOT digest_ok").limit(1).collect()
    if damaged:
        raise ValueError(f"archive was not read back as written: {damaged[0]['path']} at {damaged[0]['offset']}")
    wanted = read.filter("refers_to IS NOT NULL").select(F.col("refers_to").alias("record_id")).distinct()
    kept = read.select("record_id", F.col("number").alias("kept_number")).join(wanted, "record_id", "left_semi").withColumnRenamed("record_id", "refers_to")
    return lookup_join(read, kept, ["refers_to"]).select(
        F.col("number").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), F.col("kept_number").alias("refers_to"))
