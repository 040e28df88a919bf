"""Legacy archive converter: ARC files, versions 1 and 2, to WARC, and both read back.

An archive is a row (archive, content): a name and the bytes of one bounded file. Rows of
archives are made and read by executors alone; a written table of them is the archive store.
A record that can't be read becomes a row with an error, and reading goes on behind it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, small, text_groups, written

ARCHIVE_BYTES = 4 << 20
ARCHIVES = "archive string, content binary"
VERSION_BLOCKS = {  # fixed values: the field lists of the two ARC versions
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
KEY = b"X-Source-Key: "
SMALL_ROWS = 500_000  # payloads with copies whose responses may be broadcast; more are shuffled

_START = re.compile(rb"(?P<url>.*) (?P<ip>[0-9A-Fa-f.:]+|-) (?P<date>\d{4,14}) (?P<kind>.*)", re.S)
_LENGTH = re.compile(rb"^content-length:[ \t]*(\d+)[ \t]*\r?$", re.I | re.M)
_MD5 = re.compile("[0-9a-fA-F]{32}")


def arc_header(version: int, name: str) -> bytes:
    """The first record of an ARC file: it declares the version and the header fields."""
    body = b"%d 0 waymill\n%s\n" % (version, VERSION_BLOCKS[version])
    line = [b"filedesc://" + name.encode(), b"0.0.0.0", b"20000101000000", b"text/plain"]
    line += [b"200", b"-", b"-", b"0", name.encode()] if version == 2 else []
    return b" ".join([*line, b"%d" % len(body)]) + b"\n" + body + b"\n"


def arc_record(version: int, url: str, payload: bytes, key: int | None, name: str, offset: int) -> bytes:
    """One ARC record; the payload follows an HTTP head that also carries the source's key."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    head += b"" if key is None else KEY + b"%d\r\n" % key
    block = head + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    line = [_token(url), b"0.0.0.0", b"20000101000000", b"text/html"]
    if version == 2:
        line += [b"200", hashlib.md5(payload).hexdigest().encode(), b"-", b"%d" % offset, name.encode()]
    return b" ".join([*line, b"%d" % len(block)]) + b"\n" + block + b"\n"


def _token(url: str | None) -> bytes:
    """A URL as one field of a header line, byte for byte: only line ends are escaped, and '-' says none."""
    if not url:
        return b"-"
    return url.encode("utf-8", "surrogatepass").replace(b"\r", b"%0D").replace(b"\n", b"%0A")


def _untoken(field: bytes) -> str | None:
    return None if field == b"-" else field.decode("utf-8", "replace")


@dataclass
class ArcRecord:
    """A record of an ARC file; error tells why it is damaged, and what could be read of it stays."""

    url: str | None = None
    ip: str = "-"
    date: str = ""
    content_type: str = "-"
    block: bytes = b""
    result_code: int | None = None
    checksum: str | None = None
    location: str | None = None
    error: str | None = None


def _header(line: bytes, version: int) -> tuple[ArcRecord, int] | None:
    """A header line read from both ends, and its declared length; None if it isn't one.

    URLs and content types may hold spaces: the fields after them are split off from the right,
    and the address and the date before the content type tell where the URL ends.
    """
    rest = line.rstrip(b"\r").rsplit(b" ", len(VERSION_BLOCKS[version].split(b" ")) - 4)
    start = _START.fullmatch(rest[0])
    if not start or not rest[-1].isdigit():
        return None
    more: dict = {}
    if version == 2:
        if len(rest) != 7:
            return None
        more = {"result_code": int(rest[1]) if rest[1].isdigit() else None, "checksum": _untoken(rest[2]), "location": _untoken(rest[3])}
    text = lambda name: start[name].decode("utf-8", "replace")
    return ArcRecord(_untoken(start["url"]), text("ip"), text("date"), text("kind"), **more), int(rest[-1])


def read_arc(content: bytes) -> Iterator[ArcRecord]:
    """The records of one ARC file, plain or gzipped, by its declared lengths.

    The first record declares the version and so the header fields; without it a line is tried as
    either. Where a line isn't a header, one damaged record stands for all up to the next header. A
    record that is cut short, has an impossible date, or an MD5 checksum of other bytes is damaged too.
    """
    if content.startswith(b"\x1f\x8b"):
        content = gzip.decompress(content)
    at, version, lost = 0, None, None
    while at < len(content):
        if content[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = content.find(b"\n", at)
        line = content[at : len(content) if end < 0 else end]
        found = None
        for v in (version,) if version else (2, 1):
            found = found or (_header(line, v) if end >= 0 else None)
        if not found:
            if lost is None:
                lost = at
                yield ArcRecord(error=f"no header line at byte {at}")
            at += len(line) + 1
            continue
        record, length = found
        lost, block = None, content[end + 1 : end + 1 + length]
        at = end + 1 + length
        if (record.url or "").startswith("filedesc://"):
            head = block.split(b" ", 1)[0]
            version = int(head) if head in (b"1", b"2") else None
            if version is None:
                yield ArcRecord(url=record.url, block=block, error="unknown ARC version")
            continue
        record.block = block
        if len(block) < length:
            record.error = f"{len(block)} of {length} declared bytes"
        elif warc_date(record.date) is None:
            record.error = f"impossible date {record.date}"
        elif record.checksum and _MD5.fullmatch(record.checksum) and record.checksum.lower() not in (hashlib.md5(split_http(block)[1]).hexdigest(), hashlib.md5(block).hexdigest()):
            record.error = "checksum of other bytes"
        yield record


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head, its empty line included, and body; all is body where there is no HTTP head."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (b"", block) if end < 0 else (block[: end + 4], block[end + 4 :])


def source_key(head: bytes) -> int | None:
    at = head.find(KEY)
    return None if at < 0 else int(head[at + len(KEY) : head.index(b"\r\n", at)])


def payload_digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_date(arc_date: str) -> str | None:
    """The 14-digit ARC time as a WARC timestamp; missing digits are the earliest moment. None if there is no such time."""
    padded = (arc_date + "00000101000000"[len(arc_date) :])[:14]
    try:
        return datetime.strptime(padded, "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return None


def record_id(url: str | None, date: str, key: int | None, digest: str) -> str:
    """The identifier of a converted record, the same however often it is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {key} {digest}')}>"


def warc_record(kind: str, url: str | None, date: str, ip: str, head: bytes, payload: bytes, refers_to: str | None, content_type: str = "application/octet-stream") -> bytes:
    """One gzip member: a response, a revisit that keeps the HTTP head only, or a resource, which has no HTTP head."""
    digest, when = payload_digest(payload), warc_date(date)
    block = head if kind == "revisit" else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(url, when, source_key(head), digest)}",
        f"WARC-Date: {when}",
        f"WARC-Target-URI: {_token(url).decode('utf-8', 'surrogateescape')}",
        *([] if ip == "-" else [f"WARC-IP-Address: {ip}"]),
        f"WARC-Payload-Digest: {digest}",
        f"WARC-Block-Digest: {payload_digest(block)}",
        f"Content-Type: {content_type if kind == 'resource' else 'application/http; msgtype=response'}",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    return gzip.compress("\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def read_warc(content: bytes):
    """(headers, block) of every record of one gzipped WARC file; digests are verified."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(content))
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record starts with its version")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.partition(b":")
            headers[name.decode().lower()] = value.strip().decode("utf-8", "surrogateescape")
        block = stream.read(int(headers["content-length"]))
        if len(block) < int(headers["content-length"]) or payload_digest(block) != headers["warc-block-digest"]:
            raise ValueError(f"damaged record {headers.get('warc-record-id')}")
        yield headers, block


def write_arc(pages: DataFrame, version: int = 1) -> DataFrame:
    """ARC archives of pages(page_id, url, html): a record a row, a null html as an empty payload."""

    def run(batches):
        for batch, texts in text_groups(batches, "html", ARCHIVE_BYTES):
            urls, keys = batch.column("url").to_pylist(), batch.column("page_id").to_pylist()
            name = f"{uuid.uuid4()}.arc"
            parts, at = [arc_header(version, name)], 0
            for url, key, payload in zip(urls, keys, texts):
                at += len(parts[-1])
                parts.append(arc_record(version, url, payload, key, name, at))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts)], pa.binary())], ["archive", "content"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, ARCHIVES)


PARSED = "source_key long, url string, date string, ip string, content_type string, result_code int, location string, head binary, payload binary, digest string, bytes long, error string"


def parse_arc(archives: DataFrame) -> DataFrame:
    """PARSED: the records of ARC archives of either version, the HTTP head split off.

    digest is the hex SHA-1 of the payload, bytes its length. error is null but for damaged records.
    """

    def run(batches):
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for r in read_arc(content.as_py()):
                    head, payload = split_http(r.block)
                    rows.append((source_key(head), r.url, r.date, r.ip, r.content_type, r.result_code, r.location, head, payload, hashlib.sha1(payload).hexdigest(), len(payload), r.error))
                if rows:
                    names = [c.split() for c in PARSED.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), names)], [n for n, _ in names])

    return archives.select("content").mapInArrow(run, PARSED)


def to_warc(records: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """WARC archives of parse_arc() records, those with an error left out.

    Of records with equal payloads of least_bytes or more, the one with the largest source
    key is the response and the others revisit it; smaller payloads are always responses. A
    record without a key may revisit but is never revisited. Records without an HTTP head are
    resources. Payloads stay where they are; only those with copies are told to all tasks.
    """
    good = records.where("error is null")
    large = good.where(F.col("bytes") >= least_bytes).select("digest", "bytes", F.struct("source_key", "url", "date").alias("at"))
    best = large.groupBy("digest", "bytes").agg(F.max(F.when(F.col("at.source_key").isNotNull(), F.col("at"))).alias("best"), F.count("*").alias("copies"))
    best = best.where("copies > 1 and best is not null").select(F.col("digest").alias("d"), F.col("bytes").alias("b"), "best")
    best = small(checkpointed(best, narrow=True), SMALL_ROWS)
    joined = good.join(best, (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")), "left")

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]  # one payload at a time
                best, refers = r["best"], None
                if best is not None and best["source_key"] != r["source_key"]:
                    refers = record_id(best["url"], warc_date(best["date"]), best["source_key"], payload_digest(r["payload"]))
                kind = "revisit" if refers else "response" if r["head"] else "resource"
                parts.append(warc_record(kind, r["url"], r["date"], r["ip"], r["head"], r["payload"], refers, r["content_type"]))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([f"{uuid.uuid4()}.warc.gz"]), pa.array([b"".join(parts)], pa.binary())], ["archive", "content"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([f"{uuid.uuid4()}.warc.gz"]), pa.array([b"".join(parts)], pa.binary())], ["archive", "content"])

    return joined.select("url", "date", "ip", "content_type", "head", "payload", "source_key", "best").mapInArrow(run, ARCHIVES)


def parse_warc(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of WARC archives: record_id, record_type, refers_to_id, target_uri, date, source_key,
    payload_bytes and payload_digest (bare hex, of the full payload, for revisits as declared; null bytes where a revisit declares none), payload (null for revisits, and for all without payloads)."""
    names = ["record_id", "record_type", "refers_to_id", "target_uri", "date", "source_key", "payload_bytes", "payload_digest", "payload"]
    types = [*[pa.string()] * 5, pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows = []
                for headers, block in read_warc(content):
                    head, payload = split_http(block)
                    found = _LENGTH.search(head)
                    revisit = headers["warc-type"] == "revisit"
                    declared = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if not revisit and hashlib.sha1(payload).hexdigest() != declared:
                        raise ValueError(f"damaged payload in {headers['warc-record-id']}")
                    length = len(payload) if not revisit else int(found[1]) if found else None
                    rows.append((headers["warc-record-id"], headers["warc-type"], headers.get("warc-refers-to"), _untoken(headers["warc-target-uri"].encode("utf-8", "surrogateescape")), headers["warc-date"], source_key(head), length, declared, payload if payloads and not revisit else None))
                columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return archives.mapInArrow(run, "record_id string, record_type string, refers_to_id string, target_uri string, date string, source_key long, payload_bytes long, payload_digest string, payload binary")


def convert(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """WARC archives of pages, by way of ARC archives of both versions, each written once to the shared folder."""
    even = F.coalesce(F.col("page_id"), F.lit(0)) % 2 == 0
    arcs = written(write_arc(pages.where(even), 1).unionByName(write_arc(pages.where(~even), 2)))
    return checkpointed(to_warc(parse_arc(arcs), least_bytes))


def round_trip(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """What reading the converted archives of pages(page_id, url, html) back gives, a row a page.

    page_id, payload_bytes, payload_digest, record_type, refers_to: the revisited page_id,
    null for responses. A null or empty html is an empty payload; null urls and ids survive
    the trip; repeated rows with one id are all responses; no rows give no rows.
    """
    records = checkpointed(parse_warc(convert(pages, least_bytes), payloads=False).drop("payload"))
    # The referred record of a revisit was converted with it; ids are resolved, not recomputed.
    wanted = records.where("record_type = 'revisit'").select(F.col("refers_to_id").alias("record_id")).distinct()
    targets = records.where("record_type = 'response'").join(wanted, "record_id", "left_semi").select(F.col("record_id").alias("target_id"), F.col("source_key").alias("refers_to")).distinct()
    joined = records.join(targets, records["refers_to_id"] == targets["target_id"], "left")
    return joined.select(F.col("source_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
