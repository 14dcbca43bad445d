"""Containers packed from the documents table, inside Spark tasks.

The tables hold no archives, so every document becomes one: the packing runs as
an Arrow map over the whole table and its cost grows with it.
"""

from __future__ import annotations

import bz2
import functools
import gzip
import io
import lzma
import tarfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import closing

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.plans import views
from logquarry.session import materialize, ship_package, spread_places, spread_rows, work_path
from logquarry.sources import archives as A
from logquarry.sources.decoders import Pack, format_of
from logquarry.sources.files import listing, plain_path

IMAGE = bytes([0, 1, 2, 3])
PACKED = pa.schema([("doc_id", pa.int64()), ("path", pa.string()), ("content", pa.binary())])
PACKED_SQL = "doc_id bigint, path string, content binary"
STORED = pa.schema([("doc_id", pa.int64()), ("path", pa.string()), ("place", pa.string())])
STORED_SQL = "doc_id bigint, path string, place string"
DOCS_PER_TASK = 4_000
SQUEEZE = {
    "gz": lambda data: gzip.compress(data, 1, mtime=0),
    "bz2": lambda data: bz2.compress(data, 1),
    "xz": lambda data: lzma.compress(data, preset=0),
    "zst": lambda data: zstandard.ZstdCompressor(level=1).compress(data),
}


def make_tar(members: dict[str, bytes], extras: bool = True) -> bytes:
    """A TAR of regular members, plus a folder, a link and an unsafe name."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT) as archive:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
        if extras:
            for name, kind in (("empty", tarfile.DIRTYPE), ("link.log", tarfile.SYMTYPE)):
                info = tarfile.TarInfo(name)
                info.type, info.linkname = kind, "logs"
                archive.addfile(info)
            archive.addfile(tarfile.TarInfo("../outside.log"), io.BytesIO(b""))
    return out.getvalue()


def make_zip(members: dict[str, bytes], extras: bool = True) -> bytes:
    """A ZIP of regular members, plus a folder, a link, an unsafe and an encrypted entry."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in members.items():
            archive.writestr(name, data)
        if extras:
            archive.writestr("empty/", b"")
            link = zipfile.ZipInfo("link.log")
            link.create_system, link.external_attr = 3, 0o120777 << 16
            archive.writestr(link, b"logs")
            archive.writestr("../outside.log", b"")
            archive.writestr("secret.log", b"locked")
    data = bytearray(out.getvalue())
    if extras:
        # The encryption flag of the last central entry.
        data[data.rfind(b"PK\x01\x02") + 8] |= 1
    return bytes(data)


def members_of(doc_id: int, text: str) -> dict[str, bytes]:
    """What the container of one document holds."""
    body = text.encode()
    return {f"logs/doc-{doc_id}.log": body, "assets/image.bin": IMAGE, "日志/服务.txt": b"one\ntwo\n"}


def _packing(docs: DataFrame) -> DataFrame:
    """Documents dealt for packing, which costs far more than reading them."""
    A.bound_batches(docs.sparkSession)
    return spread_rows(docs.select("doc_id", "text"), DOCS_PER_TASK, "doc_id")


def _rows(batches: Iterator[pa.RecordBatch], pack) -> Iterator[tuple[int, str, bytes]]:
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            yield doc_id.as_py(), *pack(doc_id.as_py(), text.as_py() or "")


def _packed(docs: DataFrame, pack) -> DataFrame:
    """``doc_id, path, content``, in batches of bounded size."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), PACKED)], schema=PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, weight = [], 0
        for row in _rows(batches, pack):
            rows.append(row)
            weight += len(row[2])
            if weight >= A.OUT_BYTES:
                yield batch_of(rows)
                rows, weight = [], 0
        if rows:
            yield batch_of(rows)

    return _packing(docs).mapInArrow(run, PACKED_SQL)


def _stored(docs: DataFrame, pack) -> DataFrame:
    """``doc_id, path, place``: containers are stored by the task that packs them, and dealt again to be read."""
    folder = work_path(docs.sparkSession, "containers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with closing(Pack(folder)) as kept:
            for batch in batches:
                rows = [(i, path, kept.save(io.BytesIO(data))[0]) for i, path, data in _rows([batch], pack)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), STORED)], schema=STORED)

    stored = materialize(_packing(docs).mapInArrow(run, STORED_SQL), "stored")
    return spread_places(stored, A.CONTAINERS_PER_TASK, "place")


ZIPS = ["zip"]
TARS = ["tar", "tar.gz", "tar.bz2", "tar.xz", "tar.zst"]
STREAMS = ["log.gz", "log.bz2", "log.xz", "log.zst"]
PLAIN = ["log"]
FOREIGN = ["7z", "rar"]


def _pack_one(fmt: str, doc_id: int, text: str) -> tuple[str, bytes]:
    members, body = members_of(doc_id, text), text.encode()
    if fmt == "zip":
        data = make_zip(members)
    elif fmt.startswith("tar"):
        data = make_tar(members)
        data = SQUEEZE[fmt[4:]](data) if fmt != "tar" else data
    elif fmt in FOREIGN:
        data = bytes.fromhex("377ABCAF271C" if fmt == "7z" else "526172211A0700") + body
    elif format_of(body, "log")[0] != "plain":
        # Text that begins like a container is taken for one, unless it is an entry, known by its name.
        data = make_zip({f"doc-{doc_id}.log": body}, False)
    else:
        data = SQUEEZE[fmt[4:]](body) if fmt != "log" else body
    # Some containers carry a name that says nothing about them.
    nameless = not fmt.startswith("log") and doc_id % 7 == 4
    return f"/drop/download-{doc_id}.part" if nameless else f"/drop/doc-{doc_id}.{fmt}", data


def packed_files(spark, sf: str, formats: list[str]) -> DataFrame:
    """``doc_id, path, place``: every document packed and stored, the formats in turn."""
    docs = views.table(spark, sf, "documents")
    return _stored(docs, lambda doc_id, text: _pack_one(formats[(doc_id or 0) % len(formats)], doc_id, text))


def wide_text_files(spark, sf: str, per_file: int) -> DataFrame:
    """``path, size, modified`` of UTF-16 files, with a byte order mark, of so many documents each."""
    folder = work_path(spark, "wide_files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, current, out = [], None, None
        for batch in batches:
            for bucket, text in zip(batch.column("bucket").to_pylist(), batch.column("text").to_pylist()):
                if bucket != current:
                    if out:
                        out.close()
                    current = bucket
                    paths.append(f"{folder}/bucket={bucket}/{uuid.uuid4().hex}.log")
                    store, inside = fs.FileSystem.from_uri(paths[-1])
                    store.create_dir(inside.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(inside)
                    out.write(b"\xff\xfe")
                out.write(f"{text}\n".encode("utf-16-le"))
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    docs = views.table(spark, sf, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / per_file).alias("bucket"))
    ordered = docs.repartition("bucket").sortWithinPartitions("bucket", "doc_id").select("bucket", "text")
    ship_package(spark)
    written = materialize(ordered.mapInArrow(write, "path string"), "wide_paths")
    # Only files that the table names: a task that ran twice leaves others.
    return listing(spark, [folder]).join(written.select(plain_path(F.col("path")).alias("path")), "path", "left_semi")


def _tar_header(doc_id: int, text: str) -> tuple[str, bytes]:
    kind = doc_id % 4
    if kind == 3:
        return f"/drop/{doc_id}.tar", (text * (1 + 600 // len(text.encode() or b"x"))).encode()
    data = bytearray(make_tar(members_of(doc_id, text), False))
    if kind:
        data[257:265] = bytes(8)
        total = sum(data[:148]) + 8 * 32 + sum(data[156:512]) + (1 if kind == 2 else 0)
        data[148:156] = f"{total:06o}\0 ".encode()
    return f"/drop/{doc_id}.tar", bytes(data)


def tar_headers(spark, sf: str) -> DataFrame:
    """TARs with and without a format name, with a wrong checksum, and plain text."""
    return _packed(views.table(spark, sf, "documents"), _tar_header)


def zip_listing(spark, sf: str) -> DataFrame:
    """Entries of every document packed as a ZIP."""
    listed = A.entries(A.start_level(packed_files(spark, sf, ZIPS)))
    return listed.withColumn("doc_id", F.regexp_extract("source_path", r"(\d+)", 1).cast("bigint"))


@functools.cache
def _deeper() -> bytes:
    """A ZIP within a tar.gz, the same for every document."""
    inner = make_zip({"inside.log": b"inside\n"}, False)
    return SQUEEZE["gz"](make_tar({"inner.zip": inner}, False))


def _nested(doc_id: int, text: str) -> tuple[str, bytes]:
    """A ZIP holding a TAR, a ZIP within a tar.gz, and text posing as a TAR."""
    server = make_tar({"logs/server.log": text.encode()}, False)
    members = {"nested/diag.tar": server, "deeper.tar.gz": _deeper(), "fake.tar": b"only text", "top.log": b"top\n"}
    return f"/drop/outer-{doc_id}.zip", make_zip(members, False)


def nested_files(spark, sf: str) -> DataFrame:
    """``doc_id, path, place``: one nest of containers per document."""
    return _stored(views.table(spark, sf, "documents"), _nested)
