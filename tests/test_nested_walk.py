"""Nested containers expanded by one task, formats told in the task, places dealt by ranges, long lines."""

import bz2
import gzip
import io
import lzma

import pytest
import zstandard
from pyspark.sql import functions as F

from logquarry.constants import ArchiveLimits
from logquarry.queries.derived import make_tar, make_zip
from logquarry.sources import archives as A
from logquarry.sources import decoders as D

LIMITS = ArchiveLimits()


def stored(spark, contents):
    return A.stored(spark.createDataFrame([(f"/d/{n}", bytearray(d)) for n, d in contents.items()], "path string, content binary"))


def nests():
    deep = make_zip({"b.log": b"b\n", "c.tar.gz": gzip.compress(make_tar({"c.log": b"c\nd\n"}, False))}, False)
    good = make_tar({"in.zip": deep, "a.txt": b"a\n", "fake.zip": b"text"})
    broken = make_zip({"good.tar": make_tar({"x.log": b"x\n"}), "bad.zip": b"PK\x03\x04nothing"}, False)
    return {"good.tar.bz2": bz2.compress(good), "broken.zip": broken, "bad.zip": b"PK\x03\x04", "a.log.gz": gzip.compress(b"1\n")}


def test_small_nested_containers_are_no_level(spark):
    files = stored(spark, nests())
    levels, found = A._levels(files, LIMITS, A.SURVEY_SCHEMA, A._survey(LIMITS, A.ROOM_BYTES))
    assert len(levels) == len(found) == 1
    held = {(r.source_path, *r.chain, r.entry_path, r.size, r.error) for r in A._entry_rows(found[0], LIMITS).collect()}
    levels, found = A._levels(files, LIMITS, A.SURVEY_SCHEMA, A._survey(LIMITS, 0))
    copied = {(r.source_path, *r.chain, r.entry_path, r.size, r.error) for rows in found for r in A._entry_rows(rows, LIMITS).collect()}
    assert len(levels) == 3 and held == copied
    lines = A.nested_lines(files).collect()
    assert sorted(("::".join(r.chain), r.line_no, r.content) for r in lines if r.error is None) == [
        ("", 1, "1"), ("", 1, "a"), ("good.tar", 1, "x"), ("in.zip", 1, "b"), ("in.zip::c.tar.gz", 1, "c"), ("in.zip::c.tar.gz", 2, "d"),
    ]
    assert sorted("::".join(r.chain) for r in lines if r.error) == ["", "bad.zip", "fake.zip"]


def test_large_nested_containers_are_the_next_level(spark):
    noise = bytes(range(10, 256)) * 6_000
    inner = make_tar({"big.log": noise, "in.zip": make_zip({"x.log": b"x\n"}, False)}, False)
    files = stored(spark, {"a.zip": make_zip({"inner.tar": inner, "top.log": b"top\n"}, False)})
    levels, _ = A._levels(files, LIMITS, A.NESTED_SCHEMA, A._line_survey(LIMITS, 2**31 - 1, None))
    assert len(levels) == 2
    lines = A.nested_lines(files)
    assert [r.content for r in lines.where("entry_path = 'x.log'").collect()] == ["x"]
    assert lines.where("entry_path = 'big.log'").count() == noise.count(b"\n") + 1
    one = A.lines_of_entry(files, ["inner.tar", "in.zip", "x.log"]).collect()
    assert [(r.chain, r.content) for r in one] == [(["inner.tar", "in.zip"], "x")]


def test_formats_by_task_and_column_agree(spark):
    tar, old = make_tar({"a.log": b"a"}), bytearray(make_tar({"a.log": b"a"}, False))
    old[257:265] = bytes(8)
    old[148:156] = f"{sum(old[:148]) + 256 + sum(old[156:512]):06o}\0 ".encode()
    wrong = bytes(old[:148]) + b"000001\0 " + bytes(old[156:])
    squeezed = {"gz": gzip.compress, "bz2": bz2.compress, "xz": lzma.compress, "zst": zstandard.ZstdCompressor().compress}
    contents = {"a.zip": make_zip({"a": b"a"}), "a.tar": tar, "old.part": bytes(old), "wrong.tar": wrong, "zero.tar": bytes(1024), "zero.bin": bytes(1024),
                "a.7z": b"7z\xbc\xaf\x27\x1c..", "none": b"", "bits": b"\1" * 60 + b"a" * 540, "text": "é".encode() * 3000, "nul": b"a\0", "cut.gz": b"\x1f\x8b\x08"}
    for name, squeeze in squeezed.items():
        contents |= {f"t.{name}": squeeze(tar), f"z.tar.{name}": squeeze(bytes(1024)), f"z.{name}": squeeze(bytes(1024)), f"l.log.{name}": squeeze(b"line\n")}
    rows = A.with_format(stored(spark, contents)).select("path", "format", A.file_name(F.col("path")).alias("name"), "head", "place")
    from logquarry.functions.classify import is_text_sample

    for row in rows.withColumn("text", is_text_sample(F.col("head"))).collect():
        assert (row.path, D.format_of(row.place, row.name)[0], D.is_text(bytes(row.head))) == (row.path, row.format, row.text)


def test_places_go_to_tasks_by_ranges(spark):
    """A task reads neighbouring sections of few packs, so opened files do not grow with the square of the tasks."""
    rows = spark.range(4_000).repartition(8).selectExpr("concat('/d/', id, '.log') path", "encode(cast(id as string), 'UTF-8') content")
    kept = A.stored(rows).select(F.substring_index("place", D.SECTION, 1).alias("file"), F.spark_partition_id().alias("task"))
    packs, opened = kept.select("file").distinct().count(), kept.distinct().count()
    assert packs > 1 and opened <= packs + spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("charset", ["UTF-8", "UTF-16LE"])
def test_one_long_line_is_not_read_again_and_again(charset):
    class Counted(io.BytesIO):
        reads = 0

        def read(self, size=-1):
            self.reads += 1
            return super().read(size)

    body = ("a" * (40 << 20) + "\nend").encode(charset)
    source = Counted(body)
    got = list(D.line_chunks(source, charset, 2**31 - 1))
    assert b"".join(piece for _, _, piece, _ in got) == body and [number for number, *_ in got] == [1, 2]
    assert source.reads < 12
    stopped = Counted(body)
    with pytest.raises(ValueError, match="decoded size limit exceeded"):
        list(D.line_chunks(stopped, charset, 2**31 - 1, left=5_000))
    assert stopped.reads == 1


def test_looked_up_entries_are_not_broadcast(spark):
    """The planner takes a listing for as small as the places of its containers, so every entry was sent to every task."""
    files = stored(spark, {f"{i}.zip": make_zip({"a.log": b"a\n", "b.bin": b"\0"}, False) for i in range(20)})
    asked = files.select(F.col("path").alias("source_path"), F.explode(F.array(F.lit("a.log"), F.lit("c.log"))).alias("entry_path"))
    found = A.lookup_entries(asked, A.entries(A.start_level(files)))
    rows = found.groupBy("entry_path", "error").count().collect()
    assert sorted((r.entry_path, r.error, r["count"]) for r in rows) == [("a.log", None, 20), ("c.log", "missing", 20)]
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_task_has_one_python_process(spark, monkeypatch):
    """Maps one above another are processes of the same task at once, each with a memory of its own."""
    files, jobs, kept = stored(spark, nests()), [], A.materialize
    monkeypatch.setattr(A, "materialize", lambda df, name: jobs.append(df) or kept(df, name))
    level = A.start_level(files)
    jobs += [A.entries(level), A.entry_lines(level), A.lines_of_entry(files, ["in.zip", "b.log"]), A.all_entries(files), A.nested_lines(files)]
    maps = [df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") for df in jobs]
    assert len(maps) >= 8 and max(maps) == 1
