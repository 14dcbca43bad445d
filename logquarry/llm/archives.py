"""Legacy ARC archives and their conversion to WARC.

An ARC file begins with a version block, which says by its version how many fields the header line
of every record has; the last field is the declared length of the record.  Conversion reads ARC
files record by record and writes one WARC file for each, with identifiers, timestamps, types and
digests made from what the ARC holds.  Which payloads were seen before is settled between two passes
over the files by an aggregation over their digests; payloads never travel between executors.

Files are written to the shared work folder under names of their own for each attempt, and a table
of names, written by Spark, says which of them count; so a task that runs twice does no harm.
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
from itertools import groupby
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import materialize, quoted, rows_of, ship_package
from logquarry.session import work_path

#: Names of the header fields of each ARC version.
FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "result", "checksum", "location", "offset", "file", "length"),
}
#: The header-definition lines that go with them.
DEFINITIONS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: The profile of revisits to an identical payload.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# A new file is begun after so many bytes before compression.
FILE_BYTES = 64 << 20


def base32_sha1(data: bytes) -> str:
    """The bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def opened(path: str, write: bool = False):
    """A file on any store that Arrow knows, as a stream of bytes."""
    store, inner = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))
    if not write:
        return store.open_input_stream(inner)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    return store.open_output_stream(inner)


def unzipped(stream) -> io.BufferedReader:
    """The bytes of a plain or gzip file (one member or many), read as needed."""
    raw = io.BufferedReader(stream, 1 << 16)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) if raw.peek(2)[:2] == b"\x1f\x8b" else raw


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Header and payload of an HTTP message."""
    found = re.search(rb"\r?\n\r?\n", block)
    return (block[: found.end()], block[found.end() :]) if found else (b"", block)


def http_field(header: bytes, name: str) -> str | None:
    """The value of a header field."""
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", header)
    return found[1].decode("utf-8", "replace").strip() if found else None


# ARC


@dataclass(frozen=True)
class ArcRecord:
    """A record of an ARC file: its place there, its header fields and its bytes."""

    number: int
    fields: dict[str, str]
    block: bytes


def arc_header(version: int, **fields: object) -> bytes:
    """A header line; white space and control characters within a field are percent-encoded."""
    texts = [re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", str(fields[n])) or "-" for n in FIELDS[version]]
    return " ".join(texts).encode() + b"\n"


def version_block(name: str, version: int, date: str) -> bytes:
    """The first record of an ARC file."""
    body = f"{version} 0 logquarry\n{DEFINITIONS[version]}\n".encode()
    first = dict.fromkeys(FIELDS[2], "-") | {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": date}
    return arc_header(version, **first | {"mime": "text/plain", "length": len(body)}) + body + b"\n"


def read_arc(stream) -> Iterator[ArcRecord]:
    """The records of an ARC stream, the version block first as number 0.

    Header lines are cut from their right end, so that a URL may hold spaces.  A record shorter than
    its declared length, or a header of the wrong form, raises ``ValueError``.
    """
    number, version = 0, 1
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        names = FIELDS[version]
        parts = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
        if number == 0:  # the version is told behind this line
            ahead = stream.readline()
            version = int(ahead.split()[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            names = FIELDS[version]
            parts = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
            block = ahead + stream.read(int(parts[-1]) - len(ahead))
        elif len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"record {number} has no header of version {version}")
        else:
            block = stream.read(int(parts[-1]))
        if len(block) != int(parts[-1]):
            raise ValueError(f"record {number} ends before its declared length")
        yield ArcRecord(number, dict(zip(names, parts, strict=True)), block)
        number += 1


def write_arcs(pages: DataFrame, id_col: str, url_col: str, html_col: str, id_header: str = "X-Page-Id") -> DataFrame:
    """Legacy archives of pages, ``(path)`` each: gzip, a member a record, versions 1 and 2 in turn.

    A null page is empty, a null URL is ``about:blank``.  The page's id is kept as an HTTP header.
    """
    spark = pages.sparkSession
    ship_package(spark)
    folder = work_path(spark, "arc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, size, version = None, "", 0, 2
        paths = []
        for number, (key, url, html) in enumerate(rows_of(batches, 256)):
            date = "20000101000000"
            if out is None or size >= FILE_BYTES:
                if out is not None:
                    out.close()
                version = 3 - version
                name, size = f"{uuid.uuid4().hex}.arc.gz", 0
                paths.append(f"{folder}/{name}")
                out = opened(paths[-1], write=True)
                out.write(gzip.compress(version_block(name, version, date), 1))
            payload = (html or "").encode("utf-8", "surrogatepass")
            known = "" if key is None else f"{id_header}: {quote(str(key), safe='')}\r\n"
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{known}Content-Length: {len(payload)}\r\n\r\n"
            block = head.encode() + payload
            fields = {
                "url": url or "about:blank", "ip": "0.0.0.0", "date": date, "mime": "text/html", "result": 200,
                "checksum": base32_sha1(block), "location": "-", "offset": size, "file": name, "length": len(block),
            }
            record = arc_header(version, **fields) + block + b"\n"
            out.write(gzip.compress(record, 1))
            size += len(record)
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return materialize(pages.select(quoted(id_col), quoted(url_col), quoted(html_col)).mapInArrow(write, "path string"), "arc_files")


# WARC


def iso_date(date: str) -> str:
    """The timestamp of an ARC date of up to 14 digits, missing ones being the smallest."""
    digits = (re.sub(r"\D", "", date) + "00000101000000"[len(re.sub(r"\D", "", date)) :])[:14]
    d = digits
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts: object) -> str:
    """An identifier that is the same whenever the same record is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def warc_record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A WARC record, compressed as a member of its own."""
    lines = [f"{name}: {value}\r\n" for name, value in fields if value is not None]
    lines.append(f"Content-Length: {len(block)}\r\n\r\n")
    return gzip.compress(b"WARC/1.1\r\n" + "".join(lines).encode() + block + b"\r\n\r\n", 1)


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(fields, block)`` of each record, by declared length; field names in lower case."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record begins with its version")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("a record ends before its declared length")
        yield fields, block


def _is_http(record: ArcRecord) -> bool:
    return record.block.startswith(b"HTTP/")


def id_of(head: bytes, id_header: str | None) -> str | None:
    """The unescaped value of a header, None where there is none."""
    value = http_field(head, id_header) if id_header else None
    return None if value is None else unquote(value)


def index_arcs(arcs: DataFrame, id_header: str | None = None, id_type: str = "long") -> DataFrame:
    """``(path, number, key, url, date, payload_bytes, digest)`` of the HTTP records of ARC files ``(path)``.

    ``key`` is the value of the header ``id_header`` as ``id_type``, null where there is none of that type.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "number", "key", "url", "date", "payload_bytes", "digest"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for (path,) in rows_of(batches):
            rows = []
            with opened(path) as stream:
                for record in read_arc(unzipped(stream)):
                    if record.number == 0 or not _is_http(record):
                        continue
                    head, payload = split_http(record.block)
                    key = id_of(head, id_header)
                    fields = record.fields
                    rows.append((path, record.number, key, fields["url"], fields["date"], len(payload), base32_sha1(payload)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "path string, number long, key string, url string, date string, payload_bytes long, digest string"
    return arcs.repartition("path").mapInArrow(scan, schema).withColumn("key", F.col("key").try_cast(id_type))


def arcs_to_warcs(arcs: DataFrame, id_header: str | None = None, revisit_bytes: int = 0, id_type: str = "long") -> DataFrame:
    """WARC files ``(path)`` of ARC files ``(path)``, one for each.

    The version block becomes a ``warcinfo`` record; an HTTP record becomes a ``response`` or, if its
    payload has at least ``revisit_bytes`` bytes and an earlier record has the same, a ``revisit`` of
    that one without the payload; any other record becomes a ``resource``.  Earlier means: smaller
    value of the header ``id_header`` as ``id_type`` (records without one come last), then date, file and place.
    An empty table gives no files.
    """
    spark = arcs.sparkSession
    ship_package(spark)
    folder = work_path(spark, "warc")
    index = materialize(index_arcs(arcs, id_header, id_type), "arc_index")
    order = F.struct(F.col("key").isNull().alias("no_key"), "key", "date", "path", "number", "url").alias("r")
    large = index.where(F.col("payload_bytes") >= revisit_bytes)
    seen = large.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    seen = materialize(seen.select(F.col("digest").alias("same"), "first"), "first_records")
    known = index.join(seen, (F.col("digest") == F.col("same")) & (F.col("payload_bytes") >= revisit_bytes), "left")
    again = ~((F.col("first.path") == F.col("path")) & (F.col("first.number") == F.col("number")))
    known = known.select("path", "number", *[F.when(again, F.col(f"first.{c}")).alias(f"first_{c}") for c in ("path", "number", "url", "date")])
    # A file without HTTP records still becomes a WARC.
    every = arcs.select("path", F.lit(0).cast("long").alias("number"), *[F.lit(None).cast(t).alias(f"first_{c}") for c, t in (("path", "string"), ("number", "long"), ("url", "string"), ("date", "string"))])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, rows in groupby(rows_of(batches), key=lambda row: row[0]):
            decided = {row[1]: row[2:] for row in rows}  # as many as one file has records
            name = re.sub(r"\.arc(\.gz)?$", "", path.rpartition("/")[2])
            target = f"{folder}/{name}-{uuid.uuid4().hex}.warc.gz"
            with opened(path) as stream, opened(target, write=True) as out:
                for record in read_arc(unzipped(stream)):
                    out.write(converted(path, record, decided.get(record.number)))
            yield pa.RecordBatch.from_arrays([pa.array([target], pa.string())], ["path"])

    dealt = known.unionByName(every).repartition("path").sortWithinPartitions("path", "number")
    return materialize(dealt.mapInArrow(convert, "path string"), "warc_files")


def converted(path: str, record: ArcRecord, first: tuple | None) -> bytes:
    """The WARC record of an ARC record; ``first`` is ``(path, number, url, date)`` of the one it revisits."""
    name, fields = path.rpartition("/")[2], record.fields
    base = [("WARC-Record-ID", record_id(name, record.number)), ("WARC-Date", iso_date(fields["date"]))]
    if record.number == 0:
        block = f"software: logquarry\r\nformat: WARC File Format 1.1\r\ndescription: converted from {name}\r\n".encode() + record.block
        return warc_record([("WARC-Type", "warcinfo"), *base, ("Content-Type", "application/warc-fields")], block)
    base += [("WARC-Target-URI", fields["url"]), ("WARC-IP-Address", fields["ip"] if fields["ip"] != "0.0.0.0" else None)]
    if not _is_http(record):
        digest = ("WARC-Block-Digest", f"sha1:{base32_sha1(record.block)}")
        return warc_record([("WARC-Type", "resource"), *base, ("Content-Type", fields["mime"]), digest], record.block)
    head, payload = split_http(record.block)
    base += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")]
    if first is None or first[0] is None:
        base.append(("WARC-Block-Digest", f"sha1:{base32_sha1(record.block)}"))
        return warc_record([("WARC-Type", "response"), *base], record.block)
    base += [
        ("WARC-Profile", REVISIT_PROFILE),
        ("WARC-Refers-To", record_id(first[0].rpartition("/")[2], first[1])),
        ("WARC-Refers-To-Target-URI", first[2]),
        ("WARC-Refers-To-Date", iso_date(first[3])),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(head)}"),
        ("WARC-Truncated", "length"),
    ]
    return warc_record([("WARC-Type", "revisit"), *base], head)


def warc_records(warcs: DataFrame, id_header: str | None = None, id_type: str = "long") -> DataFrame:
    """``(record_id, record_type, url, date, key, payload_bytes, payload_digest, refers_to_id)`` of HTTP records.

    Sizes and digests are those of the full payload: of a response they are taken from its bytes, which
    must agree with the digest it carries; of a revisit from the HTTP header and digest that it keeps.
    """
    ship_package(warcs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "url", "date", "key", "payload_bytes", "payload_digest", "refers_to_id"]
        kinds = [*[pa.string()] * 5, pa.int64(), pa.string(), pa.string()]
        for (path,) in rows_of(batches):
            rows = []
            with opened(path) as stream:
                for fields, block in read_warc(unzipped(stream)):
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, payload = split_http(block)
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    size = len(payload) if kind == "response" else int(http_field(head, "Content-Length") or 0)
                    if kind == "response" and base32_sha1(payload) != digest:
                        raise ValueError(f"{path}: {fields['warc-record-id']} has another payload than its digest says")
                    rows.append(
                        (fields["warc-record-id"], kind, fields.get("warc-target-uri"), fields["warc-date"],
                         id_of(head, id_header), size, digest, fields.get("warc-refers-to"))
                    )
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = (
        "record_id string, record_type string, url string, date string, key string, payload_bytes long, "
        "payload_digest string, refers_to_id string"
    )
    return warcs.repartition("path").mapInArrow(read, schema).withColumn("key", F.col("key").try_cast(id_type))


def converted_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages through both formats: ``(<id_col>, payload_bytes, payload_digest, record_type, refers_to, url)``.

    Each page is written to an ARC file, converted, and read back from the WARC.  Of pages with equal
    bytes, that with the smallest id is a response and the others revisit it.  Ids may be of any type that
    text gives back, such as numbers and strings, and are compared as that type.  A null page counts as
    empty; a page with a null id gets a null id back and comes last; repeated rows revisit the first of
    them.  Pages of any length are kept whole.  Other columns are not read.  An empty table gives no rows.
    """
    arcs = write_arcs(pages, id_col, url_col, html_col)
    kind = pages.schema[id_col].dataType.simpleString()
    read = materialize(warc_records(arcs_to_warcs(arcs, "X-Page-Id", id_type=kind), "X-Page-Id", kind), "warc_records")
    origin = read.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("key").alias("refers_to"))
    out = read.join(origin, "refers_to_id", "left")
    return out.select(F.col("key").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
