import bz2
import gzip
import io
import lzma
import zipfile

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from logquarry.constants import ArchiveLimits
from logquarry.queries import ORACLES, QUERIES
from logquarry.queries.derived import make_tar, make_zip
from logquarry.sources import archives as A

PACK = {
    "tar": lambda d: d,
    "tar.gz": gzip.compress,
    "tar.bz2": bz2.compress,
    "tar.xz": lzma.compress,
    "tar.zst": zstandard.ZstdCompressor().compress,
}
MEMBERS = {"logs/server.log": b"one\ntwo\n", "assets/image.bin": bytes(4), "日志/服务.txt": b"x\n"}


def named(spark, contents):
    rows = [(f"/d/{n}", bytearray(d)) for n, d in contents.items()]
    return A.stored(spark.createDataFrame(rows, "path string, content binary"))


def listed(df, limits=ArchiveLimits()):
    return A.entries(A.start_level(df), limits).collect()


@pytest.mark.parametrize("fmt", list(PACK))
def test_tar_in_every_compression(spark, fmt):
    df = named(spark, {f"a.{fmt}": PACK[fmt](make_tar(MEMBERS)), "b.part": PACK[fmt](make_tar(MEMBERS))})
    rows = listed(df)
    assert len(rows) == 6 and all(r.error is None for r in rows)
    assert {r.entry_path for r in rows if r.is_log} == {"logs/server.log", "日志/服务.txt"}


def test_empty_tars(spark):
    df = named(spark, {f"e.{fmt}": PACK[fmt](bytes(1024)) for fmt in PACK})
    assert {r.format for r in A.with_format(df).collect()} == set(PACK)
    assert listed(df) == []


def test_single_streams_and_plain(spark):
    body = b"line one\nline two\n"
    df = named(spark, {
        "server.log.gz": gzip.compress(body), "server.log.bz2": bz2.compress(body), "server.log.xz": lzma.compress(body),
        "server.log.zst": zstandard.ZstdCompressor().compress(body), "notes.data": b"some text", "image.bin": bytes([0, 1, 2]),
    })
    rows = {r.source_path: r for r in listed(df)}
    assert all(rows[f"/d/server.log.{c}"].entry_path == "server.log" and rows[f"/d/server.log.{c}"].is_log for c in ("gz", "bz2", "xz", "zst"))
    assert rows["/d/notes.data"].is_log and not rows["/d/image.bin"].is_log
    lines = A.entry_lines(A.start_level(df)).where("source_path like '%server%'").orderBy("source_path", "line_no").collect()
    assert [r.content for r in lines] == ["line one", "line two"] * 4


def test_gzip_header_name_wins(spark):
    out = io.BytesIO()
    with gzip.GzipFile("real.log", "wb", fileobj=out) as f:
        f.write(b"x")
    assert [r.entry_path for r in listed(named(spark, {"other.gz": out.getvalue()}))] == ["real.log"]


def test_zip_hides_and_marks(spark):
    rows = {r.entry_path: r for r in listed(named(spark, {"a.zip": make_zip(MEMBERS)}))}
    assert set(rows) == {*MEMBERS, "secret.log"}
    assert rows["secret.log"].encrypted and not rows["secret.log"].is_log
    lines = A.entry_lines(A.start_level(named(spark, {"a.zip": make_zip(MEMBERS)}))).where("error is null").collect()
    assert "secret.log" not in {r.entry_path for r in lines}


def test_damaged_and_unsupported_give_errors(spark):
    df = named(spark, {"a.gz": b"\x1f\x8b\x08", "b.zip": b"PK\x03\x04nothing", "c.7z": b"7z\xbc\xaf\x27\x1c..", "d.bz2": b"BZh"})
    rows = listed(df)
    assert len(rows) == 4 and all(r.error and r.entry_path is None for r in rows)


def test_limits(spark):
    tar = named(spark, {"a.tar": make_tar(MEMBERS, False)})
    assert "count" in listed(tar, ArchiveLimits(max_entries=2))[0].error
    assert [r.entry_path for r in listed(tar, ArchiveLimits(max_path_bytes=8))] == []
    assert "scan size" in listed(tar, ArchiveLimits(max_scan_bytes=16))[0].error
    lines = A.entry_lines(A.start_level(named(spark, {"a.log": b"x" * 14})), ArchiveLimits(max_decoded_bytes=3)).collect()
    assert [r.error for r in lines if r.error] == ["decoded size limit exceeded"]


def nest(depth):
    data = make_zip({"inside.log": b"deep\n"}, False)
    for _ in range(depth):
        data = make_zip({"inner.zip": data}, False)
    return data


def test_nested_chains(spark):
    outer = make_zip({"nested/diagnostics.tar": make_tar(MEMBERS, False), "inner.zip": nest(0), "fake.tar": b"text"}, False)
    rows = A.all_entries(named(spark, {"outer.zip": outer})).collect()
    by_chain = {}
    for r in rows:
        by_chain.setdefault("::".join(r.chain), []).append(r.entry_path if r.error is None else r.error)
    assert set(by_chain["nested/diagnostics.tar"]) == set(MEMBERS)
    assert by_chain["inner.zip"] == ["inside.log"]
    assert by_chain["fake.tar"] == ["entry content is not an archive"]


def test_lines_within_nested_containers(spark):
    outer = make_zip({"nested/diagnostics.tar": make_tar(MEMBERS, False), "inner.zip": nest(1), "top.log": b"top\n"}, False)
    files = named(spark, {"outer.zip": outer, "bad.zip": b"PK\x03\x04nothing"})
    lines = A.nested_lines(files).collect()
    good = {("::".join(r.chain), r.entry_path, r.line_no, r.content) for r in lines if r.error is None}
    assert ("nested/diagnostics.tar", "logs/server.log", 2, "two") in good
    assert ("inner.zip::inner.zip", "inside.log", 1, "deep") in good and ("", "top.log", 1, "top") in good
    assert [r.source_path for r in lines if r.error] == ["/d/bad.zip"]
    # What cannot be opened further down is told too, once.
    limits = A.ArchiveLimits(max_nested_depth=1)
    hidden = A.nested_lines(named(spark, {"o.zip": nest(3), "f.zip": make_zip({"fake.tar": b"text"}, False)}), limits).collect()
    assert sorted(("::".join(r.chain), r.error) for r in hidden) == [
        ("fake.tar", "entry content is not an archive"), ("inner.zip::inner.zip", "nested too deep"),
    ]
    assert {r.line_no for r in hidden} == {None}
    one = A.lines_of_entry(files, ["inner.zip", "inner.zip", "inside.log"]).where("error is null").collect()
    assert [(r.source_path, r.content) for r in one] == [("/d/outer.zip", "deep")]
    assert A.lines_of_entry(files, ["absent.zip", "a.log"]).count() == 0


def test_large_containers_are_streamed(spark, tmp_path):
    """A sparse file above 2 GiB beside a small one: both are listed, neither passes through a table."""
    with open(tmp_path / "big.log", "wb") as file:
        file.truncate(2**31 + 10)
    (tmp_path / "small.zip").write_bytes(make_zip(MEMBERS, False))
    rows = A.entries(A.start_level(A.read_containers(spark, str(tmp_path)))).collect()
    assert {(r.entry_path, r.size) for r in rows if r.entry_path == "big.log"} == {("big.log", 2**31 + 10)}
    assert {r.entry_path for r in rows} == {"big.log", *MEMBERS}


def test_depth_and_running_size(spark):
    levels, errors = A.expand_nested(named(spark, {"o.zip": nest(5)}))
    assert len(levels) == 6 and errors.count() == 0
    _, errors = A.expand_nested(named(spark, {"o.zip": nest(6)}))
    assert [r.error for r in errors.collect()] == ["nested too deep"]
    _, errors = A.expand_nested(named(spark, {"o.zip": nest(2)}), ArchiveLimits(max_decoded_bytes=128))
    assert [r.error for r in errors.collect()] == ["decoded size limit exceeded"]


def test_entry_charsets_and_wide_line_breaks(spark):
    text = "第一行\r\nsecond\n末行"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("le.log", b"\xff\xfe" + text.encode("utf-16-le"))
        z.writestr("be.log", b"\xfe\xff" + text.encode("utf-16-be"))
        z.writestr("gb.log", ("中文😀\n" * 30_000).encode("gb18030"))
        z.writestr("long.log", b"x" * 65_636 + b"\n")
        z.writestr("odd.log", b"\xff\xfe" + "ਊ\nਊ".encode("utf-16-le"))
    rows = A.entry_lines(A.start_level(named(spark, {"a.zip": out.getvalue()})), limit=65_536)
    got = {}
    for r in rows.orderBy("entry_path", "line_no").collect():
        got.setdefault(r.entry_path, []).append(r)
    assert [r.content for r in got["le.log"]] == [r.content for r in got["be.log"]] == ["第一行", "second", "末行"]
    assert len(got["gb.log"]) == 30_000 and {r.content for r in got["gb.log"]} == {"中文😀"}
    assert [(len(r.content), r.truncated) for r in got["long.log"]] == [(65_536, True)]
    assert [r.content for r in got["odd.log"]] == ["ਊ", "ਊ"]


def test_entries_of_one_zip_are_many_tasks(spark):
    """A thousand entries of every method spread over the tasks and read as in one pass; damage stays where it is."""
    out = io.BytesIO()
    expected = {}
    with zipfile.ZipFile(out, "w") as z:
        for i in range(1000):
            method = (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA)[i % 4]
            lines = [f"entry {i} line {k} " + "é" * (i % 7) for k in range(i % 13)]
            z.writestr(f"logs/{i}.log", "".join(f"{x}\n" for x in lines), compress_type=method)
            expected[f"logs/{i}.log"] = lines
        z.writestr("skipped.bin", b"binary")
        z.writestr("empty/", b"")
    level = A.start_level(named(spark, {"a.zip": out.getvalue()}))
    work = A.line_work(level)
    sizes = [r.n for r in work.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 1000 and len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) < 250
    got = {}
    for r in A.entry_lines(level).orderBy("entry_path", "line_no").collect():
        assert r.error is None
        got.setdefault(r.entry_path, []).append(r.content)
    assert got == {k: [x.rstrip() if not x.strip() else x for x in v] for k, v in expected.items() if v}
    data = bytearray(out.getvalue())
    at = data.find(b"logs/5.log") + len(b"logs/5.log")
    data[at : at + 8] = bytes(8)
    rows = A.entry_lines(A.start_level(named(spark, {"b.zip": bytes(data)}))).collect()
    assert {r.entry_path for r in rows if r.error} == {"logs/5.log"}
    assert {r.entry_path for r in rows if not r.error} == set(got) - {"logs/5.log"}
    one = A.lines_of_entry(named(spark, {"a.zip": out.getvalue()}), ["logs/12.log"]).collect()
    assert sorted(r.content for r in one) == sorted(expected["logs/12.log"])


def test_lookup_and_counts(spark):
    rows = A.entries(A.start_level(named(spark, {"a.zip": make_zip(MEMBERS)})))
    asked = spark.createDataFrame([("/d/a.zip", p) for p in ("logs/server.log", "nope", "secret.log", "assets/image.bin")], "source_path string, entry_path string")
    errors = {r.entry_path: r.error for r in A.lookup_entries(asked, rows).collect()}
    assert errors == {"logs/server.log": None, "nope": "missing", "secret.log": "encrypted", "assets/image.bin": "not a log"}
    assert A.entry_counts(rows, 3).first().within_limit is False
    assert A.browsable(rows).count() == 2


def test_containers_read_from_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.zip").write_bytes(make_zip(MEMBERS))
    rows = A.entries(A.start_level(A.read_containers(spark, str(tmp_path)))).where(~F.col("encrypted"))
    assert rows.count() == 3


def test_every_document_has_its_decoded_size_judged(spark, tmp_path):
    """Empty and null texts, ids that repeat, are negative or null, and text that begins like a container."""
    begun = ["BZh9", "PK\x03\x04 a", "Rar!\x1a\x07\x00", "ustar".rjust(262) + "x" * 300]
    rows = [(i, text) for i in range(5) for text in ["", "", None, "x" * 5000, "x" * 5001, *begun, *[b + "x" * 5000 for b in begun]]]
    rows += [(-7, "one"), (None, ""), (None, "x" * 6000), (10**17, "")]
    frame = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})
    pq.write_table(frame, tmp_path / "documents.parquet")
    name = "ag_05_decoded_bytes_limit"
    got = QUERIES[name](spark, str(tmp_path)).select("doc_id", "error").collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    expected = db.execute(f"SELECT doc_id, error FROM ({ORACLES[name]})").fetchall()
    assert len(expected) == len(rows) and sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
