"""Legacy web archives: ARC files in, WARC records out, and WARC archives read back.

An ARC file starts with a version block, whose lines name the version and the fields of every record's header line; version 1 has five
fields, version 2 has ten. A record is its header line, as many bytes as the line declares, and a line end. The converter keeps the
HTTP response as the record's block and makes up the rest: identifiers are name-based UUIDs of the archive's own name (in its first line), offset and target, so a repeated run gives
the same; timestamps come from the 14 digits of the header line; digests are SHA-1 in base 32, of the block and of the payload.
A payload that another record carries is written as a revisit that refers to it.

Archives are packed in tasks, at most ``ARCHIVE`` bytes each (or one record), and written by Spark's text writer, one archive a row, in gzip files in
the shared folder; the line end after the row is the one that ends the last record. They are read as whole files, which that size bounds. Which of equal payloads is the response comes from one
aggregation by digest; payloads join it only where the list of repeated ones is too large to send along, which Spark decides by size.

Defined results: null html is an empty payload, a null url the target ``unknown:``. A null page_id loses against any other as a response, and revisits
refer to null only if all of them are null. Repeated rows each give a record; an empty table none; further columns are ignored. White space in a url
is percent-encoded, as header lines are cut at blanks. Broken archives raise an error with the file and offset.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow import session
from weirflow.llm import tables

#: Bytes of an archive before compression, beside its last record.
ARCHIVE = 8 << 20
# Header lines of the two versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "20240101000000"
NAMES = uuid.UUID("7d0cbd0e-53cf-5c6a-9a37-0c3a7ad3e1c0")
BLANK = re.compile(r"[\x00-\x20\x7f]")


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    target: str
    ip: str
    date: str
    mime: str
    block: bytes
    offset: int


# --- ARC ---------------------------------------------------------------------------------------------------------------

def arc_head(name: str, version: int) -> bytes:
    block = f"{version} 0 weirflow\n{FIELDS[version]}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {DATE} text/plain"
    if version == 2:
        line += f" 200 - - 0 {name}"
    return f"{line} {len(block)}\n".encode() + block + b"\n"


def arc_record(record: Record, version: int, name: str, offset: int) -> bytes:
    line = f"{BLANK.sub(lambda m: '%%%02X' % ord(m[0]), record.target) or 'unknown:'} {record.ip} {record.date} {record.mime}"
    if version == 2:
        line += f" 200 {sha1(record.block)} - {offset} {name}"
    return f"{line} {len(record.block)}\n".encode() + record.block + b"\n"


def read_arc(data: bytes, name: str = "") -> Iterator[Record]:
    """Records of an ARC file. The version block says how header lines are to be read."""
    at, fields = 0, None
    while at < len(data):
        if fields is not None and data[at: at + 1] in (b"\n", b"\r"):  # line ends between records
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"{name}: no header line at {at}")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        values = line.split(" ")
        names = fields or FIELDS[2 if len(values) == 10 else 1].split(" ")
        if len(values) != len(names):
            raise ValueError(f"{name}: {len(values)} fields in place of {len(names)} at {at}")
        told = dict(zip(names, values))
        length = told["Archive-length"]
        if not length.isdigit() or end + 1 + int(length) > len(data):
            raise ValueError(f"{name}: length {length} at {at}")
        block = data[end + 1: end + 1 + int(length)]
        if fields is None:
            lines = block.decode("utf-8", "replace").split("\n")
            if not line.startswith("filedesc:") or len(lines) < 2 or lines[0].split(" ")[0] not in ("1", "2"):
                raise ValueError(f"{name}: no version block")
            fields = lines[1].strip().split(" ")
            if "Archive-length" not in fields:
                raise ValueError(f"{name}: no length among the fields {fields}")
        else:
            yield Record(told["URL"], told["IP-address"], told["Archive-date"], told["Content-type"], block, at)
        at = end + 1 + int(length)


# --- WARC --------------------------------------------------------------------------------------------------------------

def archive_name(data: bytes, path: str) -> str:
    """The name that an ARC file gives itself, or that of the file."""
    line = data[: max(0, data.find(b"\n"))].decode("utf-8", "replace")
    return line.removeprefix("filedesc://").split(" ")[0] or path.rpartition("/")[2]


def cut_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its blank line) and payload."""
    at = block.find(b"\r\n\r\n")
    return (block[: at + 4], block[at + 4:]) if at >= 0 else (b"", block)


def record_id(archive: str, record: Record) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{archive} {record.offset} {record.target}')}>"


def timestamp(date: str) -> str:
    """14 digits (missing ones are filled up) to a WARC date."""
    d = date + "00000101000000"[len(date):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(headers: Iterable[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def converted(record: Record, archive: str, response: tuple[str, str, str] | None) -> bytes:
    """The WARC record of an ARC record; ``response`` is the target, date and id of the record that has its payload, for a revisit."""
    head, payload = cut_http(record.block)
    block = head if response else record.block
    headers = [
        ("WARC-Type", "revisit" if response else "response"), ("WARC-Record-ID", record_id(archive, record)), ("WARC-Date", timestamp(record.date)),
        ("WARC-Target-URI", record.target), ("WARC-IP-Address", record.ip), ("WARC-Payload-Digest", f"sha1:{sha1(payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Type", "application/http;msgtype=response")]
    if response:
        headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", response[2]), ("WARC-Refers-To-Target-URI", response[0]), ("WARC-Refers-To-Date", timestamp(response[1]))]
    return warc_record(headers, block)


def read_warc(data: bytes, name: str = "") -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"{name}: no record at {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        stop = start + int(headers["content-length"])
        if data[stop: stop + 4] != b"\r\n\r\n":
            raise ValueError(f"{name}: the record at {at} doesn't end where it declares")
        yield headers, data[start:stop]
        at = stop + 4


# --- on Spark ----------------------------------------------------------------------------------------------------------

def write_archives(packed: DataFrame, path: str, end: str) -> None:
    """One file for each row of ``packed`` (archive, a binary). The text writer adds ``end``, which the archive's last record lacks."""
    (packed.select(F.col("archive").cast("string")).write.option("lineSep", end).option("maxRecordsPerFile", 1)
     .option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path))


def archives(spark, path: str) -> DataFrame:
    """(path, content) of the gzip files in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def unpacked(content: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while content:
        one = zlib.decompressobj(31)
        out += [one.decompress(content), one.flush()]
        content = one.unused_data
    return b"".join(out)


def http_response(page_id: int | None, payload: bytes) -> bytes:
    own = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def http_field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode() if m else None


def as_arc(version: int):
    """(page_id, url, html) rows to packed ARC archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size, name, n = [], 0, "", 0
        task = TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            return pa.record_batch({"archive": pa.array([b"".join(part)[:-1]], pa.binary())})

        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if not part:
                    name, n = f"{uuid.uuid5(NAMES, f'{version} {task} {n} {page_id} {url}')}.arc", n + 1
                    part = [arc_head(name, version)]
                    size = len(part[0])
                block = http_response(page_id, html or b"")
                part.append(arc_record(Record(url or "unknown:", "0.0.0.0", DATE, "text/html", block, 0), version, name, size))
                size += len(part[-1])
                if size >= ARCHIVE:
                    yield out()
                    part = []
        if part:
            yield out()

    return run


PARSED = "archive string, spot bigint, page_id bigint, target string, ip string, date string, mime string, record_id string, digest string, length bigint, sha256 string, block binary"


def parse_arc(full: bool):
    """ARC files to records; without ``full``, all but their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, part, size = unpacked(content.as_py()), [], 0
                name = archive_name(data, path)
                for r in read_arc(data, path):
                    head, payload = cut_http(r.block)
                    page_id = http_field(head, "X-Page-Id")
                    part.append({"archive": name, "spot": r.offset, "page_id": None if page_id is None else int(page_id), "target": r.target, "ip": r.ip, "date": r.date,
                                 "mime": r.mime, "record_id": record_id(name, r), "digest": sha1(payload), "length": len(payload),
                                 "sha256": hashlib.sha256(payload).hexdigest(), "block": r.block if full else None})
                    size += len(r.block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(part, ARROW)
                        part, size = [], 0
                if part:
                    yield pa.RecordBatch.from_pylist(part, ARROW)

    return run


ARROW = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split(" ") for x in PARSED.split(", "))])


def as_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parsed records, with the response that each revisit refers to (or nulls), to packed WARC archives."""
    part, size = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            response = (row["to_target"], row["to_date"], row["to_id"]) if row["to_id"] is not None else None
            record = Record(row["target"], row["ip"], row["date"], row["mime"], row["block"], row["spot"])
            part.append(converted(record, row["archive"], response))
            size += len(part[-1])
            if size >= ARCHIVE:
                yield pa.record_batch({"archive": pa.array([b"".join(part)[:-4]], pa.binary())})
                part, size = [], 0
    if part:
        yield pa.record_batch({"archive": pa.array([b"".join(part)[:-4]], pa.binary())})


def convert(spark, arcs: str, warcs: str, least: int = 0) -> None:
    """The ARC files in the folder ``arcs`` as WARC files in the new folder ``warcs``. Payloads of ``least`` bytes or more are carried once:
    by the record with the largest page id, then the largest record id."""
    files = archives(spark, arcs)
    told = files.mapInArrow(parse_arc(False), PARSED).where(F.col("length") >= least)
    best = F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "record_id", "target", "date")).alias("best")
    again = told.groupBy("sha256", "length").agg(best, F.count("*").alias("n")).where("n > 1").select(
        "sha256", "length", F.col("best.record_id").alias("to_id"), F.col("best.target").alias("to_target"), F.col("best.date").alias("to_date"))
    again = tables.keep(again, "warc-again")
    records = files.mapInArrow(parse_arc(True), PARSED).join(again, ["sha256", "length"], "left")
    own = lambda c: F.when(F.col("to_id") != F.col("record_id"), F.col(c)).alias(c)
    rows = records.select("archive", "spot", "target", "ip", "date", "mime", "record_id", "block", own("to_id"), own("to_target"), own("to_date"))
    write_archives(rows.mapInArrow(as_warc, "archive binary"), warcs, "\r\n\r\n")


READ = "record_id string, page_id bigint, target string, payload_bytes bigint, payload_digest string, record_type string, to_id string"


def read_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WARC files to one row per record; digests of responses are checked against their payloads."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            out = []
            for headers, block in read_warc(unpacked(content.as_py()), path):
                head, payload = cut_http(block)
                page_id, length = http_field(head, "X-Page-Id"), http_field(head, "Content-Length")
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                if headers["warc-type"] == "response" and sha1(payload) != digest:
                    raise ValueError(f"{path}: {headers['warc-record-id']} has another payload than its digest says")
                size = int(length) if headers["warc-type"] == "revisit" and length else len(payload)
                out.append((headers["warc-record-id"], None if page_id is None else int(page_id), headers["warc-target-uri"], size, digest, headers["warc-type"], headers.get("warc-refers-to")))
            if out:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[x.split(" ")[0] for x in READ.split(", ")])


def records(spark, warcs: str) -> DataFrame:
    return archives(spark, warcs).mapInArrow(read_records, READ)


def round_trip(pages: DataFrame, versions: tuple[int, ...] = (1, 2), least: int = 0) -> DataFrame:
    """Pages to ARC files to WARC files and back: page_id, payload_bytes, payload_digest, record_type, refers_to of every row. A hash of the page
    says which of the versions its archive has."""
    spark = pages.sparkSession
    arcs, warcs = session.shared_dir(spark, "arc"), session.shared_dir(spark, "warc")
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string").cast("binary"))
    own = F.pmod(F.xxhash64("page_id", "url"), F.lit(len(versions)))
    packed = [rows.where(own == i).mapInArrow(as_arc(v), "archive binary") for i, v in enumerate(versions)]
    write_archives(reduce(DataFrame.unionByName, packed), arcs, "\n")
    convert(spark, arcs, warcs, least)
    session.delete_dir(spark, arcs)
    back = tables.keep(records(spark, warcs).drop("target"), "warc-records")
    session.delete_dir(spark, warcs)
    responses, own = back.where("record_type = 'response'"), ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    named = responses.select(F.col("record_id").alias("to_id"), F.col("page_id").alias("refers_to"))
    revisits = back.where("record_type = 'revisit'").join(named, "to_id", "left").select(*own)
    return responses.withColumn("refers_to", F.lit(None).cast("bigint")).select(*own).unionByName(revisits)
