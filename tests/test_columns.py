import pytest
from pyspark.sql import functions as F

from logquarry.functions import classify as K
from logquarry.functions import paths as P
from logquarry.functions import text as X

V = F.col("v")


def test_names_and_parents(column):
    paths = ["/a/b.log", "C:\\x\\y.TXT", "plain"]
    assert column(paths, P.file_name(V)) == ["b.log", "y.TXT", "plain"]
    assert column(paths, P.parent_dir(V)) == ["/a", "C:\\x", "plain"]
    assert column(["a.LOG", ".bashrc", "x.", "a.b.Gz", "none"], P.extension(V)) == ["log", "", "", "gz", ""]
    assert column(["a.tar.gz", ".gz", "x"], P.file_stem(V)) == ["a.tar", ".gz", "x"]


def test_keys_and_containment(column):
    assert column(["c:/A/b", "/A/b"], P.path_key(V)) == ["c:\\a\\b", "/A/b"]
    assert column(["C:\\", "C:\\a\\\\b\\", "/", "//a//b/"], P.comparable(V)) == ["c:/", "c:/a/b", "/", "/a/b"]
    root = P.comparable(F.lit("c:/users/alice/logs"))
    paths = ["C:\\Users\\Alice\\Logs\\app.log", "C:\\Users\\Alice\\Logs-old\\app.log", "C:\\Users\\Alice\\Logs"]
    assert column(paths, P.within(P.comparable(V), root)) == [True, False, True]
    assert column(paths, P.strictly_within(P.comparable(V), root)) == [True, False, False]
    assert column(["/a/b", "c:/a", "/", "x/y"], P.ancestor_keys(V)) == [
        ["/", "/a", "/a/b"], ["c:/", "c:/a"], ["/"], ["x", "x/y"],
    ]


def test_directory_chain(column):
    got = column(["C:\\logs\\a\\b\\deep.zip", "D:\\logs-other\\x"], P.directory_chain(F.lit("C:\\logs"), V))
    assert got == [["C:\\logs", "C:\\logs\\a", "C:\\logs\\a\\b"], []]
    assert column(["/r/x", "/r", "/r/a//b/c"], P.directory_chain(F.lit("/r"), V)) == [["/r"], [], ["/r", "/r/a", "/r/a/b"]]


def test_entry_keys(column):
    keys = ["/d/o.zip", "/d/o.zip::in.tar::a/b.log"]
    assert column(keys, P.entry_title(V)) == ["o.zip", "b.log"]
    assert column(keys, P.entry_archive(V)) == ["/d/o.zip", "/d/o.zip::in.tar"]
    assert column(keys, P.breadcrumb(V)) == ["/d/o.zip", "o.zip › in.tar › a/b.log"]
    assert column(["\\\\?\\UNC\\h\\s", "\\\\?\\C:\\x", "/x"], P.user_facing(V)) == ["\\\\h\\s", "C:\\x", "/x"]


def test_levels(column):
    lines = ["2026-07-15 10:00:17 INFO  [w] x", "WARNING x", "a INFO b ERROR", "error", "éERROR", "_ERROR"]
    assert column(lines, X.log_level(V)) == ["INFO", None, "INFO", None, "ERROR", None]


def test_human_size(column):
    sizes = [0, 1023, 1024, 1280, 102_400, 1024**2, 3 * 1024**3, None]
    assert column(sizes, X.human_size(V), "bigint") == ["0B", "1023B", "1.0KB", "1.3KB", "100KB", "1.0MB", "3.0GB", ""]


def test_tokens(column):
    names = ["DataPatchController.log", "错误.log", "log.h", "HTTPServer", "a" * 50]
    got = [set(t) for t in column(names, X.name_tokens(V))]
    assert got[0] >= {"data", "patch", "controller", "datapatchcontroller", "log"}
    assert got[1] == {"错误", "log"}
    assert got[2] == {"log", "h"}
    assert got[3] == {"http", "server", "httpserver"}
    assert got[4] == set()
    assert X.query_tokens('Data_Patch "x" (y)') == ["data", "patch", "x", "y"]
    assert column(["ab", "abcd", "aaaa"], X.trigrams(V)) == [[], ["abc", "bcd"], ["aaa"]]


def test_highlight(column):
    assert column(["Error in a.b errors"], X.highlight(V, "error a.b")) == ["<mark>Error</mark> in <mark>a.b</mark> <mark>error</mark>s"]
    assert column(["abc ab"], X.highlight(V, "ab abc")) == ["<mark>abc</mark> <mark>ab</mark>"]
    assert column(["x"], X.highlight(V, "  ")) == ["x"]


def test_charsets(spark, column):
    whole = "é" * 3000
    samples = [
        b"\xef\xbb\xbfa", b"\xff\xfea\0", b"\xfe\xff\0a", "ok".encode(), "中文".encode("gb18030"), b"",
        b"a" + whole.encode(),
    ]
    samples = [bytearray(s) for s in samples]
    assert column(samples, X.detect_charset(V), "binary") == ["UTF-8", "UTF-16LE", "UTF-16BE", "UTF-8", "GB18030", "UTF-8", "UTF-8"]
    assert X.charset_name(" utf-8 ") == "UTF-8"
    with pytest.raises(ValueError):
        X.charset_name("latin1")
    with X.lenient_charsets(spark):
        expr = X.decode_bytes(V, X.detect_charset(V))
        got = column([bytearray("中文😀".encode("gb18030")), bytearray(b"a\xff\xfeb")], expr, "binary")
    assert got[0] == "中文😀"
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == "false"


def test_magic_and_samples(column):
    heads = [b"PK\x03\x04x", b"7z\xbc\xaf\x27\x1cx", b"Rar!\x1a\x07\x00", b"\x1f\x8bxx", b"BZh9", b"text"]
    got = column([bytearray(h) for h in heads], K.detect_format(V, F.lit("fake.zip")), "binary")
    assert got == ["zip", "7z", "rar", "gz", "bz2", "plain"]
    zeros = [bytearray(1024)]
    assert column(zeros, K.detect_format(V, F.lit("a.tar")), "binary") == ["tar"]
    assert column(zeros, K.detect_format(V, F.lit("a.log")), "binary") == ["plain"]
    samples = [b"", b"a\0b", b"plain\ttext\r\n", bytes([1, 2, 3, 4]), b"\x01" + b"a" * 20]
    assert column([bytearray(s) for s in samples], K.is_text_sample(V), "binary") == [True, False, True, False, True]


def test_arrivals_and_filters(column):
    names = ["bundle.ZIP", "server.LOG", "image.bin"]
    archive = K.is_archive_name(V)
    assert column(names, K.passes_filter(V, archive, [".log"])) == [True, True, False]
    assert column(names, K.passes_filter(V, archive, [".log"], True)) == [True, True, True]
    unsafe = ["../outside.log", "C:\\outside.log", "/a", "\\a", "a::b", "a/../b", "", "日" * 1400, "a\0b"]
    assert column(unsafe, K.is_safe_entry(V, 4096)) == [False] * len(unsafe)
    assert column(["logs/a.log", "日志/服务.txt", "a..b"], K.is_safe_entry(V, 4096)) == [True] * 3
    assert column(["a.tar.GZ", "a.tzst", "a.zst", "a.log"], K.archive_format_by_name(V)) == ["tar.gz", "tar.zst", "zst", None]
