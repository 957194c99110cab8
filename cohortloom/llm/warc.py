"""Legacy ARC archives to WARC: parse headers by version and declared length, synthesise the WARC record fields.

An ARC file starts with a version block whose second line gives the version; its third line names the fields of the
record headers that follow. Version 1 headers have five fields, version 2 headers ten. A record's content is the
declared number of bytes, whatever they hold, then one line feed.

The converter gives each record a stable identifier (a UUID from its archive position and digest), turns the
14-digit time into an ISO time, derives the record type and writes payload and block digests. Records with equal
payloads of at least ``least`` bytes become revisits of the one with the smallest key."""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable
from .files import new_folder, read_files, write_files

#: The header fields of both ARC versions.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
        "Filename", "Archive-length"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY_HEADER = "X-Source-Key"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
RECORDS = ("record_id string, key long, uri string, ip string, date string, mime string, head binary, response binary, "
           "payload_bytes long, payload_digest string")
FOUND = "record_id string, key long, record_type string, payload_bytes long, payload_digest string, refers string"


@dataclass(frozen=True)
class ArcRecord:
    fields: dict[str, str]
    content: bytes
    offset: int


def arc_bytes(version: int, rows: list[tuple[str | None, str, bytes]], name: str = "pages") -> bytes:
    """An ARC archive of (url, 14-digit time, content); white space in a URL is percent-encoded, null is ``-``."""
    head = f"{version} 0 cohortloom\n{' '.join(FIELDS[version])}\n\n"
    out = [f"filedesc://{name}.arc 0.0.0.0 20000101000000 text/plain {'200 - - 0 ' + name + ' ' if version == 2 else ''}"
           f"{len(head)}\n{head}\n".encode()]
    at = len(out[0])
    for url, date, content in rows:
        extra = f"200 - - {at} {name}.arc " if version == 2 else ""
        line = f"{quote(url, safe=':/?#[]@!$&()*+,;=%~.-_') if url else '-'} 0.0.0.0 {date} text/html {extra}{len(content)}\n"
        out += [line.encode(), content, b"\n"]
        at += len(line.encode()) + len(content) + 1
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of one archive in order, without its version block. Blank lines between records are skipped; a header
    with the wrong number of fields or content shorter than declared raises ValueError."""
    at, names = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].rstrip(b"\r")
        if not line:
            at = end + 1
            continue
        parts = line.decode("utf-8", "replace").split(" ")
        length = int(parts[-1])
        content = data[end + 1:end + 1 + length]
        if len(content) < length:
            raise ValueError(f"record at {at} declares {length} bytes, {len(content)} are left")
        if names is None:
            version = int(content.split(b" ", 1)[0])
            names = FIELDS[version]
        else:
            if len(parts) != len(names):
                raise ValueError(f"record at {at} has {len(parts)} header fields, not {len(names)}")
            yield ArcRecord(dict(zip(names, parts)), content, at)
        at = end + 1 + length + 1


def _split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP head and payload; content without a head is all payload."""
    if content.startswith(b"HTTP/"):
        head, cut, body = content.partition(b"\r\n\r\n")
        if cut:
            return head + cut, body
    return b"", content


def _header(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n"):
        key, cut, value = line.partition(b":")
        if cut and key.decode("latin-1").lower() == name.lower():
            return value.decode("latin-1").strip()
    return None


def _convert(content: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORDS.split(", ")]
        types = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.binary(), pa.binary(), pa.int64(), pa.string()]
        ordinal = 0
        for batch in batches:
            for archive in batch.column(0):
                data = archive.as_py()
                if data is None:
                    continue
                data = b"".join(members(data)) if data[:2] == b"\x1f\x8b" else data
                origin, ordinal = f"{TaskContext.get().partitionId()}/{ordinal}", ordinal + 1
                rows = []
                for r in parse_arc(data):
                    head, payload = _split_http(r.content)
                    digest = hashlib.sha256(payload).hexdigest()
                    key = _header(head, KEY_HEADER)
                    d = r.fields["Archive-date"]
                    row = {"record_id": f"urn:uuid:{uuid.uuid5(SPACE, f'{origin}:{r.offset}:{digest}')}",
                           "key": int(key) if key else None, "uri": r.fields["URL"], "ip": r.fields["IP-address"],
                           "date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
                           "mime": r.fields["Content-type"], "head": head if content else None, "response": None,
                           "payload_bytes": len(payload), "payload_digest": digest}
                    if content:
                        row["response"] = _member(warc_record(row, None, r.content))
                    rows.append(tuple(row[n] for n in names))
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    return run


def convert(archives: DataFrame, content: bool = True) -> DataFrame:
    """Records of ARC archives (binary column content, plain or gzip) with the synthesised WARC values.

    ``response`` is the finished WARC record, one gzip member; without ``content`` it and ``head`` stay null. An
    archive's task and place in it go into its identifiers, so both forms give the same ones."""
    return archives.select("content").mapInArrow(_convert(content), RECORDS)


def members(data: bytes) -> Iterator[bytes]:
    """Every member of a gzip file, unpacked."""
    view, at, step = memoryview(data), 0, 1 << 15
    while at < len(view):
        member, out = zlib.decompressobj(wbits=31), []
        while not member.eof:
            part = view[at:at + step]
            if not len(part):
                raise ValueError("gzip member is cut short")
            out.append(member.decompress(part))
            at += len(part) - len(member.unused_data)
        yield b"".join(out)


def _member(data: bytes) -> bytes:
    member = zlib.compressobj(1, zlib.DEFLATED, 31)
    return member.compress(data) + member.flush()


def warc_record(row: dict, refers: str | None, block: bytes) -> bytes:
    """A response record around ``block``, or a revisit record of the record ``refers``."""
    fields = [
        ("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", f"<{row['record_id']}>"),
        ("WARC-Date", row["date"]), ("WARC-Target-URI", row["uri"]), ("WARC-IP-Address", row["ip"]),
        ("Content-Type", "application/http;msgtype=response"), ("WARC-Identified-Payload-Type", row["mime"]),
        ("WARC-Profile", PROFILE if refers else None), ("WARC-Refers-To", f"<{refers}>" if refers else None),
        ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    lines = [f"{k}: {v}" for k, v in fields if v is not None]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for r in batch.to_pylist():
                held.append(r["response"] if r["refers"] is None else _member(warc_record(r, r["refers"], r["head"])))
                size += len(held[-1])
                if size >= file_bytes:
                    yield pa.record_batch([pa.array([b"".join(held)], pa.binary())], names=["content"])
                    held, size = [], 0
        if held:
            yield pa.record_batch([pa.array([b"".join(held)], pa.binary())], names=["content"])
    return write


def mark_revisits(records: DataFrame, digests: DataFrame, least: int = 100) -> DataFrame:
    """``records`` with ``refers``: the identifier of the response with an equal payload, null for responses.

    ``digests`` are the same records, without content where that is cheaper. They are counted in a pass of their own,
    so payloads of one digest never have to meet; only digests that occur twice are joined. Of equal keys the smallest identifier is the response; null keys come last."""
    order = F.struct(F.col("key").isNull().alias("none"), "key", "record_id")
    first = (digests.where(F.col("payload_bytes") >= least).groupBy("payload_digest")
             .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
             .select("payload_digest", F.col("first.record_id").alias("origin")))
    return records.join(first, "payload_digest", "left").withColumn(
        "refers", F.when(F.col("origin") != F.col("record_id"), F.col("origin"))).drop("origin")


def write_warc(records: DataFrame, folder: str, file_bytes: int = 16 << 20) -> None:
    """Gzip WARC files, one member per record, below ``folder``; ``refers`` tells revisits from responses."""
    write_files(records.mapInArrow(_write(file_bytes), "content binary"), "content", folder, EMPTY_MEMBER)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of one WARC file by declared lengths."""
    for record in members(data):
        at = 0
        while at < len(record):
            end = record.index(b"\r\n\r\n", at)
            fields = dict(line.split(": ", 1) for line in record[at:end].decode().split("\r\n")[1:])
            length = int(fields["Content-Length"])
            yield fields, record[end + 4:end + 4 + length]
            at = end + 4 + length + 4


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in FOUND.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for fields, block in parse_warc(content.as_py()):
                head, payload = _split_http(block)
                key = _header(head, KEY_HEADER)
                if fields["WARC-Type"] == "response":
                    n, digest, refers = len(payload), hashlib.sha256(payload).hexdigest(), None
                    if f"sha256:{digest}" != fields["WARC-Payload-Digest"]:
                        raise ValueError(f"{fields['WARC-Record-ID']}: payload does not match its digest")
                else:
                    n, digest = int(_header(head, "Content-Length") or 0), fields["WARC-Payload-Digest"][7:]
                    refers = fields["WARC-Refers-To"][1:-1]
                rows.append((fields["WARC-Record-ID"][1:-1], int(key) if key else None, fields["WARC-Type"], n, digest, refers))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records found in the WARC files: identifier, source key, type, payload length and digest, revisited record."""
    return read_files(spark, folder).mapInArrow(_read, FOUND)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {1: [], 2: []}
    size = {1: 0, 2: 0}
    for batch in batches:
        for r in batch.to_pylist():
            body = (r["html"] or "").encode()
            key = f"{KEY_HEADER}: {r['page_id']}\r\n" if r["page_id"] is not None else ""
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{key}Content-Length: {len(body)}\r\n\r\n"
            version = 1 + (r["page_id"] or 0) % 2
            held[version].append((r["url"], "20000101000000", head.encode() + body))
            size[version] += len(body)
            if size[version] >= 2 << 20:
                yield pa.record_batch([pa.array([arc_bytes(version, held[version])], pa.binary())], names=["content"])
                held[version], size[version] = [], 0
    for version, rows in held.items():
        if rows:
            yield pa.record_batch([pa.array([arc_bytes(version, rows)], pa.binary())], names=["content"])


def arc_archives(pages: DataFrame) -> DataFrame:
    """Legacy archives of ``pages`` (page_id, url, html): version 1 for even ids, version 2 for odd ones."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.col("html").alias("html"))
    return rows.mapInArrow(_build, "content binary")


def archive_pages(pages: DataFrame, least: int = 100) -> DataFrame:
    """Pages through ARC archives, the converter and WARC files, described from the files that were read back:
    (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Null html is an empty payload; repeated rows are records of their own; of equal page_ids the smallest record
    identifier is the response. No pages give no rows."""
    spark = pages.sparkSession
    folder = new_folder(spark)
    archives = arc_archives(pages)
    write_warc(mark_revisits(convert(archives), convert(archives, content=False), least), folder)
    found = durable(read_warc(spark, folder))
    origin = found.where("record_type = 'response'").select(F.col("record_id").alias("refers"), F.col("key").alias("refers_to"))
    revisits = found.where("refers IS NOT NULL").join(origin, "refers", "left")
    responses = found.where("refers IS NULL").withColumn("refers_to", F.lit(None).cast("long"))
    return revisits.unionByName(responses).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
