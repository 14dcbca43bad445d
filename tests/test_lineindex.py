"""The stored line index against whole-file reading, and the bytes that a range reads."""

import random

import pytest
from pyspark.sql import functions as F

from logquarry import api
from logquarry.sources import lineindex as X
from logquarry.sources.files import listing
from logquarry.sources.textlines import lines_of_content


def texts():
    rng = random.Random(2)
    words = ["alpha", "βήτα", "日本語", "ß", "𝄞", "ਊ", "ਊ", "ഊ਍", "x" * 300, ""]

    def text(n, end="\n"):
        return "".join(" ".join(rng.choices(words, k=rng.randint(0, 12))) + end for _ in range(n))

    return {
        "utf8.log": text(900).encode(),
        "bom.log": b"\xef\xbb\xbf" + text(40, "\r\n").encode(),
        "gb.log": ("日志 服务 错误\n" * 700).encode("gb18030"),
        "le.log": b"\xff\xfe" + text(700, "\r\n").encode("utf-16-le"),
        "be.log": b"\xfe\xff" + (text(700) + "last").encode("utf-16-be"),
        "open.log": text(30).encode() + b"no line feed",
        "one.log": b"x" * 200_000,
        "feeds.log": b"\n" * 3000,
        "empty.log": b"",
        "late.log": ("a" * 20_000 + "\n").encode() + b"\xff\n",
        "mark.log": b"\xff\xfe",
    }


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("texts")
    for name, data in texts().items():
        (path / name).write_bytes(data)
    return str(path)


def whole(spark, folder):
    """All lines by decoding each file at once; charsets by all bytes."""
    rows = []
    for name, data in texts().items():
        try:
            charset = X.marked_charset(data) or (data.decode() and "UTF-8") or "UTF-8"
        except UnicodeDecodeError:
            charset = "GB18030"
        df = spark.createDataFrame([(f"{folder}/{name}", bytearray(data))], "path string, content binary")
        rows += [(r.path, r.line_no, r.content) for r in lines_of_content(df, charset).collect()]
    return sorted(rows)


@pytest.mark.parametrize("range_bytes, span_bytes, every", [(4096, 1024, 7), (32 << 20, 256 << 10, 1000), (1 << 14, 1 << 15, 1)])
def test_splits_give_the_lines_of_whole_files(spark, folder, range_bytes, span_bytes, every):
    index = X.index_lines(spark, folder, range_bytes=range_bytes, span_bytes=span_bytes, every=every)
    assert index.columns == X._INDEX
    got = X.indexed_lines(index).collect()
    assert sorted((r.path, r.line_no, r.content) for r in got) == whole(spark, folder)
    sizes = {}
    for r in got:
        sizes[r.path] = sizes.get(r.path, 0) + r.raw_len
    assert sizes == {f"{folder}/{n}": len(d) for n, d in texts().items() if d}
    spans = index.collect()
    # Spark's listing leaves out files without bytes.
    assert {r.path for r in spans} == {f"{folder}/{n}" for n, d in texts().items() if d}
    assert all(r.lines <= every for r in spans)
    charsets = {r.path.rpartition("/")[2]: r.charset for r in spans}
    assert charsets["gb.log"] == charsets["late.log"] == "GB18030" and charsets["le.log"] == charsets["mark.log"] == "UTF-16LE" and charsets["utf8.log"] == "UTF-8"


def test_ranges(spark, folder, tmp_path):
    index = X.index_lines(spark, folder, folder=str(tmp_path / "index"), every=50, span_bytes=4096, range_bytes=1 << 16)
    every = whole(spark, folder)
    for start, count in ((0, 1), (0, 49), (49, 2), (690, 200), (2999, 5), (10**6, 10)):
        got = sorted((r.path, r.line_no, r.content) for r in X.indexed_range(index, start, count).collect())
        assert got == [r for r in every if start < r[1] <= start + count]
        one = X.indexed_range(index, start, count, path=f"{folder}/le.log").collect()
        assert sorted((r.path, r.line_no, r.content) for r in one) == [r for r in got if r[0].endswith("le.log")]
    cut = X.indexed_range(index, 0, 1, path=f"{folder}/one.log", limit=65_536).collect()
    assert [(len(r.content), r.raw_len, r.truncated) for r in cut] == [(65_536, 200_000, True)]


def test_a_range_of_a_large_file_reads_little(spark, tmp_path, monkeypatch):
    line = b"2024-01-01 00:00:00 INFO a line of a hundred bytes or so, as logs have them, number %010d" + b"." * 20 + b"\n"
    block = b"".join(line % i for i in range(25_000))
    (tmp_path / "large").mkdir()
    with open(tmp_path / "large/a.log", "wb") as out:
        for _ in range(256 * 2**20 // len(block) + 1):
            out.write(block)
    index = X.index_lines(spark, str(tmp_path / "large"))
    rows = index.selectExpr("max(n_lines) n", "max(size) size").first()
    assert rows.size > 256 * 2**20 and rows.n == rows.size // len(line % 0)
    wanted = X.range_spans(index, 1_500_000, 200)
    assert wanted.selectExpr("sum(end - offset)").first()[0] < 2 * 2**20
    assert api.indexed_range(index, 1_500_000, 200).count() == 200
    # What is read of those spans, counted where it is read.
    read = []

    class Counting:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def __getattr__(self, name):
            return getattr(self.file, name)

        def read(self, size):
            data = self.file.read(size)
            read.append(len(data))
            return data

    plain = X.opened
    monkeypatch.setattr(X, "opened", lambda path: Counting(plain(path)))
    found = [line for r in wanted.collect() for line in X.span_lines(r.path, r.offset, r.end, r.charset, r.skip, r["take"])]
    assert len(found) == 200 and sum(read) < 2 * 2**20
    assert found[0][1] == line[:-1] % (1_500_000 % 25_000)


def test_a_file_without_bytes_has_a_span_without_lines(spark, folder):
    files = spark.createDataFrame([(f"{folder}/empty.log", 0, None)], "path string, size long, modified timestamp")
    index = X.index_files(files)
    assert [(r.line, r.lines, r.offset, r.end, r.n_lines) for r in index.collect()] == [(0, 0, 0, 0, 0)]
    assert X.indexed_lines(index).collect() == []


def test_changed_files(spark, folder, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / name).write_bytes(b"one\ntwo\n")
    index = X.index_lines(spark, str(tmp_path))
    assert X.changed_files(index, listing(spark, [str(tmp_path)])).collect() == []
    (tmp_path / "a").write_bytes(b"one\ntwo\nthree\n")
    (tmp_path / "b").unlink()
    (tmp_path / "d").write_bytes(b"new\n")
    changed = X.changed_files(index, listing(spark, [str(tmp_path)])).collect()
    assert sorted(r.path.rpartition("/")[2] for r in changed) == ["a", "b", "d"]
    # Lines that were there are still found; a file that lost bytes is an error.
    assert [r.content for r in X.indexed_range(index, 0, 9, path=f"{tmp_path}/a").orderBy("line_no").collect()] == ["one", "two"]
    (tmp_path / "c").write_bytes(b"one\n")
    with pytest.raises(Exception, match="shorter than when it was indexed"):
        X.indexed_range(index, 0, 9, path=f"{tmp_path}/c").collect()
    assert index.where(F.col("n_lines") != 2).count() == 0
