"""Legacy web archives (ARC) to WARC.

An ARC file starts with a version block that says which fields its header lines have: five
in version 1, ten in version 2. A record is such a line, then as many bytes as its last field
declares, then a line end. The converter reads by these lengths alone and makes
what a WARC record needs and ARC lacks: an identifier (a version 5 UUID of the record's
place), a date in ISO form, a type, and SHA-256 digests. A payload that an earlier
record already has becomes a revisit.

Archives are compressed record by record. Each task writes files under names of its own,
and the rows that Spark commits name those that count.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipmill.llm.common import NewFile, open_folder, staged, table
from snipmill.session import new_folder

#: Shorter payloads are never merged into a revisit.
LEAST_SHARED = 100
#: Fields of a header line by the version of the file.
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "file", "length"),
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:converted-archive")
#: The reading buffer of archives.
BUFFER = 1 << 20
END = b"\r\n\r\n"


class Damaged(ValueError):
    """An archive that breaks its own format."""


# --- ARC --------------------------------------------------------------------------------

def arc_version_block(version: int, date: str) -> bytes:
    names = "URL IP-address Archive-date Content-type Archive-length" if version == 1 else (
        "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length")
    body = f"{version} 0 converter\n{names}\n".encode()
    head = f"filedesc://pages.arc 0.0.0.0 {date} text/plain"
    extra = "" if version == 1 else " 200 - - 0 pages.arc"
    return f"{head}{extra} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, body: bytes, offset: int) -> bytes:
    """One record; white space and control characters of the URL are escaped, as they part fields and lines."""
    name = quote(url, safe="!#$%&'()*+,/:;=?@[]~<>\"{}|\\^`") or "unknown:"
    extra = "" if version == 1 else f" 200 - - {offset} pages.arc"
    return f"{name} 0.0.0.0 {date} text/html{extra} {len(body)}\n".encode("ascii") + body + b"\n"


def _exactly(stream, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise Damaged(f"{n} bytes declared, {len(data)} there")
    return data


def read_arc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, content) of each record after the version block."""
    fields = None
    while line := stream.readline():
        if line in (b"\n", b"\r\n"):
            continue
        values = line.decode("latin-1").rstrip("\r\n").split(" ")
        names = fields or FIELDS[1 if len(values) == len(FIELDS[1]) else 2]
        if len(values) < len(names) or not values[-1].isdigit():
            raise Damaged(f"header line {line[:80]!r}")
        # A URL that holds blanks is what stands before the other fields.
        values = [" ".join(values[:len(values) - len(names) + 1]), *values[len(values) - len(names) + 1:]]
        found = dict(zip(names, values, strict=True))
        content = _exactly(stream, int(found["length"]))
        if fields is None:
            if not found["url"].startswith("filedesc:"):
                raise Damaged("no version block")
            version = content.split(b" ", 1)[0]
            if not version.isdigit() or int(version) not in FIELDS:
                raise Damaged(f"version {version[:10]!r}")
            fields = FIELDS[int(version)]
            continue
        yield found, content


# --- compressed members -----------------------------------------------------------------

def packed(data: bytes) -> bytes:
    coder = zlib.compressobj(1, zlib.DEFLATED, 31)
    return coder.compress(data) + coder.flush()


class Members(io.RawIOBase):
    """The text of a file of gzip members, read in pieces."""

    def __init__(self, file) -> None:
        self.file, self.coder, self.left = file, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            data = self.left or self.file.read(BUFFER)
            if self.coder.eof:
                if not data:
                    return 0
                self.coder = zlib.decompressobj(31)
            elif not data:
                if self.coder.unconsumed_tail:
                    raise Damaged("member cut off")
                return 0
            out = self.coder.decompress(data, len(buffer))
            self.left = self.coder.unused_data if self.coder.eof else self.coder.unconsumed_tail
            if out:
                buffer[:len(out)] = out
                return len(out)


def members(folder: str, path: str) -> io.BufferedReader:
    fs, _ = open_folder(folder)
    return io.BufferedReader(Members(fs.open_input_stream(path)), BUFFER)


# --- WARC -------------------------------------------------------------------------------

def iso_date(date: str) -> str:
    """ARC dates have up to 14 digits; missing parts are the earliest."""
    digits = (date if date.isdigit() else "")[:14]
    filled = digits + "19700101000000"[len(digits):]
    try:
        return datetime.strptime(filled, "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def record_id(place: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, place)}>"


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """Header block with its empty line, and payload."""
    at = content.find(END)
    return (b"", content) if at < 0 else (content[:at + 4], content[at + 4:])


def warc_record(fields: dict[str, str], content: bytes, place: str, revisit_of: dict | None) -> bytes:
    head, payload = split_http(content)
    block = head if revisit_of else content
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit_of else 'response'}",
             f"WARC-Target-URI: {fields['url']}", f"WARC-Date: {iso_date(fields['date'])}", f"WARC-Record-ID: {record_id(place)}",
             f"WARC-IP-Address: {fields['ip']}", "Content-Type: application/http; msgtype=response",
             f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
             f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if revisit_of:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(revisit_of['place'])}",
                  f"Refers-To-Page-Id: {revisit_of['page']}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("latin-1", "replace") + END + block + END


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record, by its declared length."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise Damaged(f"version line {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("latin-1").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, _exactly(stream, int(fields["content-length"]))


# --- jobs -------------------------------------------------------------------------------

_LENGTH = re.compile(rb"^content-length: *(\d+)", re.I | re.M)
_PAGE = re.compile(rb"^x-page-id: *(-?\d+)", re.I | re.M)


def write_arc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """ARC files of all rows, both versions in turn; returns (path, version)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, version, date = None, 1, "20250101000000"
        for batch in batches:
            for page, name, text in zip(*batch.columns, strict=True):
                if out is None:
                    version = 1 + (page.as_py() or 0) % 2
                    out = NewFile(folder, ".arc.gz")
                    out.write(packed(arc_version_block(version, date)))
                payload = (text.as_py() or "").encode("utf-8", "surrogatepass")
                about = "" if page.as_py() is None else f"X-Page-Id: {page.as_py()}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{about}Content-Length: {len(payload)}\r\n\r\n"
                out.write(packed(arc_record(version, name.as_py() or "", date, head.encode() + payload, out.tell())))
        if out is not None:
            yield pa.RecordBatch.from_pydict({"path": [out.close()], "version": pa.array([version], pa.int32())})

    thin = pages.select(F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("url"),
                        F.col(html).cast("string").alias("html"))
    return staged(thin.mapInArrow(write, "path string, version int"), "arc-files")


def _each(files: DataFrame, work, schema: str, name: str) -> DataFrame:
    """A row of ``files`` to a task."""
    many = files.count()
    return staged(files.repartition(max(1, many)).mapInArrow(work, schema), name)


def arc_digests(files: DataFrame, folder: str) -> DataFrame:
    """(path, number, page, bytes, digest) of every ARC record, without its payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for number, (_, content) in enumerate(read_arc(members(folder, path))):
                    head, payload = split_http(content)
                    page = _PAGE.search(head)
                    rows.append({"path": path, "number": number, "page": int(page[1]) if page else None,
                                 "bytes": len(payload), "digest": hashlib.sha256(payload).hexdigest()})
                    if len(rows) >= 8192:
                        yield pa.RecordBatch.from_pylist(rows, _ARC_ROWS)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, _ARC_ROWS)

    return _each(files, read, "path string, number long, page long, bytes long, digest string", "arc-records")


_ARC_ROWS = pa.schema([("path", pa.string()), ("number", pa.int64()), ("page", pa.int64()),
                       ("bytes", pa.int64()), ("digest", pa.string())])


def first_records(records: DataFrame) -> DataFrame:
    """(path, number, revisit_of) of the records that repeat a payload.

    The one with the smallest page id stays; a missing id comes last, and equal ids follow
    their places. The smallest of each digest is found before the shuffle as far as can be, and
    only digests that occur again take part in the join.
    """
    place = F.struct(F.col("page").isNull().alias("no_page"), "page", "path", "number")
    again = staged(records.where(F.col("bytes") >= LEAST_SHARED).groupBy("digest").agg(
        F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "arc-first")
    joined = records.where(F.col("bytes") >= LEAST_SHARED).join(again, "digest")
    return joined.where("NOT (path = first.path AND number = first.number)").select(
        "path", "number", F.struct(F.concat_ws("#", "first.path", "first.number").alias("place"),
                                   F.col("first.page").alias("page")).alias("revisit_of"))


def convert(files: DataFrame, folder: str, records: DataFrame) -> DataFrame:
    """A WARC file for each ARC file; returns (path)."""
    revisits = first_records(records)
    # An ARC file is the work of one task, and so are the decisions on its records.
    decisions = staged(revisits.groupBy("path").agg(F.collect_list(F.struct(
        "number", F.col("revisit_of.place").alias("place"), F.col("revisit_of.page").alias("page"))).alias("revisits")), "revisits")
    work = files.select("path").join(decisions, "path", "left").select("path", "revisits")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                known = {r["number"]: r for r in row["revisits"] or ()}
                out = NewFile(folder, ".warc.gz")
                for number, (fields, content) in enumerate(read_arc(members(folder, row["path"]))):
                    out.write(packed(warc_record(fields, content, f"{row['path']}#{number}", known.get(number))))
                yield pa.RecordBatch.from_pydict({"path": [out.close()]})

    return _each(work, write, "path string", "warc-files")


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every WARC record.

    Digests of blocks and full payloads are computed again; a difference is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for fields, block in read_warc(members(folder, path)):
                    head, payload = split_http(block)
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                    if hashlib.sha256(block).hexdigest() != fields["warc-block-digest"].removeprefix("sha256:"):
                        raise Damaged(f"{path}: block digest")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise Damaged(f"{path}: payload digest")
                    page, refers = _PAGE.search(head), fields.get("refers-to-page-id", "None")
                    rows.append({
                        "page_id": int(page[1]) if page else None,
                        "payload_bytes": int(_LENGTH.search(head)[1]) if kind == "revisit" else len(payload),
                        "payload_digest": digest, "record_type": kind,
                        "refers_to": None if refers == "None" else int(refers), "target_uri": fields["warc-target-uri"]})
                    if len(rows) >= 8192:
                        yield pa.RecordBatch.from_pylist(rows, _WARC_ROWS)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, _WARC_ROWS)

    many = files.count()
    return files.repartition(max(1, many)).mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string")


_WARC_ROWS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string())])


def archive(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages to ARC, ARC to WARC; returns the WARC files (path).

    A null page is an empty payload, a null URL is ``unknown:``, a null id is left out of the
    record. Rows that repeat an id are records of their own. An empty table gives no file. Other columns are not read.
    """
    files = write_arc(pages, folder, key, url, html)
    return convert(files, folder, arc_digests(files, folder))


def op3_warc(spark, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "archives")
    return read_archives(archive(table(spark, sf_dir, "pages"), folder), folder).drop("target_uri")


OP3_SQL = f"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_SHARED} AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_SHARED} AND first <> page_id THEN first END AS refers_to
FROM f
"""

QUERIES = {"op3_warc": op3_warc}
ORACLES = {"op3_warc": OP3_SQL}
