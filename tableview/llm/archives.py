"""Legacy web archives: ARC files (version 1 and 2) read and converted to WARC.

An ARC file opens with a version block, whose second line names the version; each record is a
header line of five fields (version 1) or ten (version 2), the last of which declares how many bytes follow.
Lengths are trusted, never separators inside a body; URLs with blanks are read from the right. A
record becomes

* `WARC-Record-ID`: a name-based UUID of the file's name and the record's place, the same each time;
* `WARC-Date`: the 14-digit (or shorter) date in ISO form;
* `WARC-Type`: `response` for a web answer, `revisit` for one whose payload a smaller source has,
  `resource` for anything else;
* `WARC-Block-Digest`, `WARC-Payload-Digest`: SHA-1 in base 32.

Writing and reading go through Spark's own sources: the text writer ends each record with the two
line ends that WARC asks for, so any store that Spark can write to holds the archives. The rows
are dealt to files of about `FILE_BYTES` of payload. Reading follows the declared lengths again and
checks every digest.

A null html is an empty payload, a null url an empty one. Rows with the same page_id and payload
have the same type. A row without page_id is a revisit if another page has its payload, else a
response. A body shorter than declared is kept and marked `WARC-Truncated: length`; a header line
that fits no version raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableview.llm.tables import written
from tableview.storage import new_path

FILE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
END = "\r\n\r\n"
CRAWLED = "20000101000000"

_VERSION_BLOCK = {
    1: ("1 0 tableview", "URL IP-address Archive-date Content-type Archive-length"),
    2: (
        "2 0 tableview",
        "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename "
        "Archive-length",
    ),
}


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _arc_header(version: int, url: str, date: str, mime: str, offset: int, name: str, body: bytes):
    url = re.sub(r"\s", lambda match: f"%{ord(match[0]):02X}", url)
    middle = "" if version == 1 else f" 200 {base32_sha1(body)} - {offset} {name}"
    return f"{url} 0.0.0.0 {date} {mime}{middle} {len(body)}\n".encode()


def arc_file(name: str, version: int, records: list[tuple[str, str, str, bytes]]) -> bytes:
    """An ARC file of (url, date, mime, body) records."""
    block = "\n".join([*_VERSION_BLOCK[version], "", ""]).encode()
    file = _arc_header(version, f"filedesc://{name}", CRAWLED, "text/plain", 0, name, block)
    file += block + b"\n"
    for url, date, mime, body in records:
        file += _arc_header(version, url, date, mime, len(file), name, body) + body + b"\n"
    return file


@dataclass
class ArcRecord:
    offset: int
    url: str
    ip: str
    date: str
    mime: str
    body: bytes
    truncated: bool


def read_arc(name: str, content: bytes) -> Iterator[ArcRecord]:
    """The records after the version block."""
    at, version = 0, 0
    while at < len(content):
        if content[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = content.find(b"\n", at)
        end = len(content) if end < 0 else end
        line = content[at:end].decode("utf-8", "replace").rstrip("\r")
        # The version block itself has the fields of its version.
        fields = line.rsplit(" ", 9 if version == 2 or not version and line.count(" ") >= 9 else 4)
        if len(fields) not in (5, 10) or not fields[-1].isdigit():
            raise ValueError(f"{name} at {at}: no ARC header: {line[:200]!r}")
        length = int(fields[-1])
        body = content[end + 1 : end + 1 + length]
        if not version:
            found = re.match(rb"([12]) ", body)
            if not line.startswith("filedesc:") or not found:
                raise ValueError(f"{name}: no ARC version block")
            version = int(found[1])
        else:
            yield ArcRecord(at, *fields[:4], body, len(body) < length)
        at = end + 1 + length


def iso_date(date: str) -> str:
    digits = re.sub(r"[^0-9]", "", date)[:14]
    digits += "00000101000000"[len(digits) :]
    return (
        f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"
    )


def record_id(name: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{offset}')}>"


def _split(record: ArcRecord) -> tuple[bytes, bytes]:
    """The protocol headers and the payload of a body."""
    if record.body.startswith(b"HTTP/"):
        for end in (b"\r\n\r\n", b"\n\n"):
            at = record.body.find(end)
            if at >= 0:
                return record.body[: at + len(end)], record.body[at + len(end) :]
    return b"", record.body


CONVERTED = (
    "source string, id string, type string, url string, date string, ip string, mime string, "
    "truncated boolean, head binary, payload binary, payload_digest string"
)
_CONVERTED = pa.schema(
    [(name, pa.string()) for name in ("source", "id", "type", "url", "date", "ip", "mime")]
    + [("truncated", pa.bool_()), ("head", pa.binary()), ("payload", pa.binary())]
    + [("payload_digest", pa.string())]
)


def converted(archives: DataFrame) -> DataFrame:
    """The records of ARC files (name, content), ready to be written as WARC."""

    def convert(batches):
        for batch in batches:
            rows, size = [], 0
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for record in read_arc(name, content.as_py()):
                    head, payload = _split(record)
                    rows.append(
                        (
                            name,
                            record_id(name, record.offset),
                            "response" if head else "resource",
                            record.url,
                            iso_date(record.date),
                            record.ip,
                            record.mime,
                            record.truncated,
                            head,
                            payload,
                            base32_sha1(payload),
                        )
                    )
                    size += len(record.body)
                    if size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
            if rows:
                yield _batch(rows)

    return archives.select("name", "content").mapInArrow(convert, CONVERTED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(column, field.type) for column, field in zip(zip(*rows), _CONVERTED)]
    return pa.RecordBatch.from_arrays(columns, schema=_CONVERTED)


def warc_record(row: dict) -> bytes:
    """The record without its final line ends. `first`, if given, is the (source, id) of the
    record whose payload it repeats."""
    first = row.get("first_id")
    block = row["head"] if first else row["head"] + row["payload"]
    web = bool(row["head"])
    headers = [
        ("WARC-Type", "revisit" if first else row["type"]),
        ("WARC-Record-ID", row["id"]),
        ("WARC-Date", row["date"]),
        ("WARC-Target-URI", row["url"]),
        ("WARC-IP-Address", row["ip"]),
        ("WARC-Block-Digest", "sha1:" + base32_sha1(block)),
        ("WARC-Payload-Digest", "sha1:" + row["payload_digest"]),
        ("X-Payload-Length", str(len(row["payload"]))),
        ("X-Source", row["source"]),
    ]
    if first:
        profile = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
        headers += [
            ("WARC-Profile", profile),
            ("WARC-Refers-To", first),
            ("X-Refers-To-Source", row["first_source"]),
        ]
    if row["truncated"]:
        headers.append(("WARC-Truncated", "length"))
    headers += [
        ("Content-Type", "application/http; msgtype=response" if web else row["mime"]),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers)
    return f"WARC/1.0\r\n{lines}\r\n".encode() + block


def _info(records: bytes) -> bytes:
    block = b"software: tableview\r\nformat: WARC File Format 1.0\r\n"
    identity = uuid.uuid5(uuid.NAMESPACE_OID, hashlib.sha1(records).hexdigest())
    return (
        f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{identity}>\r\n"
        f"WARC-Date: {iso_date(CRAWLED)}\r\nContent-Type: application/warc-fields\r\n"
        f"Content-Length: {len(block)}\r\n\r\n"
    ).encode() + block


def write_warc(records: DataFrame, path: str) -> None:
    """Write converted records (with first_source and first_id for revisits) as gzipped WARC, a
    file for each partition."""
    names = records.columns

    def write(batches):
        begun = False
        for batch in batches:
            lines, size = [], 0
            for values in zip(*batch.columns):
                record = warc_record({name: v.as_py() for name, v in zip(names, values)})
                if not begun:
                    lines.append(_info(record))
                    begun = True
                lines.append(record)
                size += len(record)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], names=["value"])
                    lines, size = [], 0
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], names=["value"])

    lines = records.mapInArrow(write, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", END).option("compression", "gzip").text(path)


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by the declared lengths."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        lines = content[at : max(end, at)].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        begin = end + 4
        block = content[begin : begin + int(headers["Content-Length"])]
        at = begin + len(block) + 4
        if content[at - 4 : at] != b"\r\n\r\n":
            raise ValueError(f"{headers['WARC-Record-ID']}: not of the declared length")
        yield headers, block


READ = (
    "id string, type string, url string, date string, source string, refers_to string, "
    "refers_to_source string, payload_bytes long, payload_digest string"
)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files of a folder, except their info records; every digest and
    length is checked."""

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                unzip = zlib.decompressobj(31)
                for headers, block in parse_warc(unzip.decompress(content.as_py())):
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    if headers["WARC-Block-Digest"] != "sha1:" + base32_sha1(block):
                        raise ValueError(f"{headers['WARC-Record-ID']}: its block has changed")
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(headers["X-Payload-Length"])
                    if headers["WARC-Type"] != "revisit":
                        payload = block[len(block) - size :]
                        if base32_sha1(payload) != digest:
                            raise ValueError(f"{headers['WARC-Record-ID']}: its payload has changed")
                    get = headers.get
                    rows.append(
                        (
                            get("WARC-Record-ID"),
                            get("WARC-Type"),
                            get("WARC-Target-URI"),
                            get("WARC-Date"),
                            get("X-Source"),
                            get("WARC-Refers-To"),
                            get("X-Refers-To-Source"),
                            size,
                            digest,
                        )
                    )
                if rows:
                    *texts, size, digest = zip(*rows)
                    names = [part.split()[0] for part in READ.split(", ")]
                    columns = [pa.array(column, pa.string()) for column in texts]
                    columns += [pa.array(size, pa.int64()), pa.array(digest, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, READ)


def arc_pages(pages: DataFrame) -> DataFrame:
    """page_id, name and content of an ARC file per page: even ids in version 1, odd in version 2."""

    def build(batches):
        for batch in batches:
            names, contents = [], []
            for page, url, html in zip(*(column.to_pylist() for column in batch.columns)):
                payload = (html or "").encode()
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                body = f"{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                name = "page-" + ("" if page is None else str(page))
                record = ((url or "", CRAWLED, "text/html", body),)
                contents.append(arc_file(name, 1 + (page or 0) % 2, record))
                names.append(name)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(contents, pa.binary())],
                names=["name", "content"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(build, "name string, content binary")


def archived(pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write a WARC record for every page. Of records with equal payloads of `least_bytes` or more,
    that of the smallest page_id holds the payload and the others refer to it."""
    page = F.nullif(F.substring("source", 6, 30), F.lit("")).cast("long")
    records = converted(arc_pages(pages)).withColumn("page", page)
    size = F.octet_length("payload")
    listed = written(
        records.select("page", "source", "id", "payload_digest", size.alias("size")), "listed"
    )
    least = listed.where("page IS NOT NULL").where(F.col("size") >= least_bytes)
    firsts = least.groupBy("payload_digest").agg(
        F.min(F.struct("page", "source", "id")).alias("first")
    )
    repeats = listed.where(F.col("size") >= least_bytes).join(firsts, "payload_digest")
    repeats = repeats.where("page IS NULL OR page > first.page").select(
        F.col("id").alias("repeat"),
        F.col("payload_digest").alias("repeated"),
        F.col("first.source").alias("first_source"),
        F.col("first.id").alias("first_id"),
    )
    repeats = repeats.distinct().hint("shuffle_hash")
    total = listed.agg(F.sum("size")).head()[0] or 0
    files = max(1, -(-total // file_bytes))
    same = (F.col("id") == F.col("repeat")) & (F.col("payload_digest") == F.col("repeated"))
    joined = records.drop("page").repartition(files, "id").join(
        repeats.repartition(files, "repeat"), same, "left"
    )
    write_warc(joined.drop("repeat", "repeated"), path)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages as WARC archives to the shared folder and read them back: a row per page."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    archived(pages, path, least_bytes)
    number = r"nullif(substring({}, 6), '')"
    return read_warc(spark, path).select(
        F.expr(number.format("source")).cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        F.expr(number.format("refers_to_source")).cast("long").alias("refers_to"),
    )
