import random

import pytest
from pyspark.sql import functions as F

from logquarry.operators import lines as L
from logquarry.plans.blocked import id_block, with_running
from logquarry.sources import textlines as T


def content(df):
    return [r.content for r in df.orderBy("line_no").collect()]


def write(folder, name, data):
    (folder / name).write_bytes(data)
    return str(folder / name)


@pytest.mark.parametrize(
    "data, expected",
    [
        (b"one\ntwo\nlast", ["one", "two", "last"]),
        (b"\nalpha\r\n\nomega", ["", "alpha", "", "omega"]),
        (b"\xef\xbb\xbffirst\r\nsecond\n", ["first", "second"]),
        (b"a\rb\r\r\n", ["a\rb"]),
        (b"", []),
    ],
)
def test_splittable_and_whole_agree(spark, tmp_path, data, expected):
    path = write(tmp_path, "a.log", data)
    assert content(T.read_lines(spark, path)) == expected
    whole, refused = T.read_whole_files(spark, path)
    assert content(whole) == expected and refused.count() == 0


def test_charsets(spark, tmp_path):
    gb = write(tmp_path, "gb.log", "中文😀\n第二行\n".encode("gb18030"))
    assert content(T.read_lines(spark, gb, "gb18030")) == ["中文😀", "第二行"]
    whole, _ = T.read_whole_files(spark, gb)
    assert content(whole) == ["中文😀", "第二行"]
    plain = write(tmp_path, "le.log", "alpha\nbeta\ngamma".encode("utf-16-le"))
    assert content(T.read_whole_files(spark, plain, "UTF-16LE")[0]) == ["alpha", "beta", "gamma"]
    with pytest.raises(ValueError):
        T.read_lines(spark, plain, "UTF-16LE")


def test_truncation(spark, tmp_path):
    path = write(tmp_path, "long.log", b"x" * 65_636 + b"\n" + b"y" * 65_535 + b"\n")
    rows = T.read_lines(spark, path, limit=65_536).orderBy("line_no").collect()
    assert [(len(r.content), r.truncated) for r in rows] == [(65_536, True), (65_535, False)]
    whole = T.read_lines(spark, path).orderBy("line_no").collect()
    assert [(len(r.content), r.truncated) for r in whole] == [(65_636, False), (65_535, False)]


def test_numbers_across_many_splits(spark, tmp_path):
    rng = random.Random(1)
    expected = {}
    for name in ("a.log", "b.log", "c.log"):
        lines = ["w" * rng.randrange(0, 90) + str(i) for i in range(rng.randrange(500, 3000))]
        write(tmp_path, name, "\n".join(lines).encode())
        expected[name] = lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        raw = T.raw_lines(spark, str(tmp_path))
        assert raw.select("path", "block_start").distinct().count() > 20
        rows = T.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {}
    for r in rows:
        got.setdefault(r.path.split("/")[-1], {})[r.line_no] = r.content
    for name, lines in expected.items():
        assert [got[name][i + 1] for i in range(len(lines))] == lines
        assert len(got[name]) == len(lines)


def test_size_limit(spark):
    listed = spark.createDataFrame([("a", 14), ("b", 2)], "path string, size bigint")
    kept, refused = T.split_by_limit(listed, 3)
    assert [r.path for r in kept.collect()] == ["b"]
    assert [(r.path, r.error) for r in refused.collect()] == [("a", "size limit")]


def test_ranges(spark):
    rows = L.split_text(spark.createDataFrame([("f", "\nalpha\r\n\nomega")], "path string, text string"))
    assert content(L.read_range(rows, 3, 10)) == ["omega"]
    assert content(L.read_range(rows, 4, 10)) == []
    assert content(L.read_range(rows, 0, 0)) == []
    assert L.line_counts(rows).first().n_lines == 4


def test_running_values_do_not_depend_on_blocks(spark):
    rng = random.Random(3)
    # One key holds a third of the rows.
    items = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(20)}", rng.randrange(100)) for i in range(3000)]
    df = spark.createDataFrame(items, "seq bigint, key string, v bigint").repartition(7)

    def answer(block_rows):
        out = with_running(df, ["key"], "seq", id_block("seq", block_rows), "n", {"before": F.col("v")}, {"prev": "v"}, {"nxt": "v"})
        return sorted(
            map(tuple, out.select("seq", "key", "v", "n", "before", F.coalesce("prev", F.lit(-1)), F.coalesce("nxt", F.lit(-1))).collect())
        )

    state, latest, expected = {}, {}, []
    for seq, key, v in items:
        n, total, prev = state.get(key, (0, 0, -1))
        expected.append([seq, key, v, n + 1, total, prev, -1])
        if n:
            latest[key][-1] = v
        latest[key] = expected[-1]
        state[key] = (n + 1, total + v, v)
    assert answer(10) == answer(257) == answer(10**6) == sorted(map(tuple, expected))


def test_export_is_byte_exact(spark, tmp_path):
    contents = {
        "crlf.log": b"first\r\nsecond\r\nlast",
        "long.log": b"x" * 70_000 + b"\n" + b"y" * 20 + b"\nz",
        "gb.log": "中文\n第二行\nend\n".encode("gb18030"),
        "more.log": b"1\n2\n3\n4\n",
    }
    (tmp_path / "in").mkdir()
    for name, data in contents.items():
        write(tmp_path / "in", name, data)
    lines = T.read_lines(spark, str(tmp_path / "in"))
    for published in (2, 3, 99):
        facts = L.export_lines(lines, published, str(tmp_path / f"out{published}")).collect()
        assert len(facts) == 4
        for r in facts:
            data = contents[r.path.rpartition("/")[2]]
            whole = data.splitlines(keepends=True)
            expected = b"".join(whole[:published])
            with open(r.target, "rb") as file:
                assert file.read() == expected
            assert (r.n_lines, r.bytes, r.complete) == (min(published, len(whole)), len(expected), len(whole) <= published)


def test_each_file_has_its_own_charset(spark, tmp_path):
    late = "plain ascii\n" * 1000 + "第二行\n"
    write(tmp_path, "a.log", "héllo\n".encode())
    write(tmp_path, "b.log", late.encode("gb18030"))
    rows = T.read_lines(spark, str(tmp_path)).where("line_no in (1, 1001)").collect()
    assert {r.content for r in rows} == {"héllo", "plain ascii", "第二行"}
