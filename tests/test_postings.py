"""Stored posting lists against the scan of the catalog, over versions, and what a query reads of them."""

import re

import pytest
from pyspark.sql import functions as F

from logquarry import api
from logquarry.operators import search as S
from logquarry.plans import views
from logquarry.sources.postings import Postings

QUERIES = ["doc", "doc tar", "gz doc tar", "zip", "nothing", "doc nothing", "src1/en", "data/src7/ .log", "/x", ":", "错误", "日志/服务", "...", "x" * 50]


def same(lists, table, queries=QUERIES[2:8:2], name=None):
    for query in queries:
        plain, listed = S.search(table, query, name, 0, 5000), S.search(table, query, name, 0, 5000, postings=lists)
        assert [r.path for r in listed.items.collect()] == [r.path for r in plain.items.collect()], (query, name)


@pytest.fixture
def table(spark, sf):
    some = spark.createDataFrame([("/l/错误.log", "错误.log", True, False), ("/日志/服务/a.log", "a.log", True, False)], "path string, name string, is_log boolean, is_archive boolean")
    return views.catalog(spark, sf).unionByName(some, allowMissingColumns=True)


def test_versions(spark, table, tmp_path):
    lists = Postings(spark, str(tmp_path / "lists"), table.schema)
    assert lists.state() == (None, None) and lists.matching("doc", None, table) is None
    same(lists, table, ["doc"])
    lists.build(table, 3)
    same(lists, table, QUERIES)
    same(lists, table, QUERIES[:2], "log")
    stats = S.search(table, "doc tar", "archive", 0, 5, postings=lists).stats.first()
    assert stats.total == S.search(table, "doc tar", "archive", 0, 5).stats.first().total > 5
    # Rows that change, come and go, twice.
    renamed = table.where("doc_id % 4 = 1").withColumn("name", F.lit("renamed.tar.gz"))
    gone = table.where("doc_id % 5 = 2").select("path")
    second = table.join(gone, "path", "left_anti").where("doc_id % 4 <> 1 OR doc_id IS NULL").unionByName(renamed.join(gone, "path", "left_anti"))
    lists.add(renamed.join(gone, "path", "left_anti"), gone, 4)
    same(lists, second)
    back = table.where("doc_id % 20 = 17")
    third = second.join(back, "path", "left_anti").unionByName(back)
    lists.add(back, back.select("path").limit(0), 5)
    same(lists, third)
    # A version that was written and not committed is not seen.
    lists._write(table.limit(5), table.select("path"), 6)
    same(lists, third)
    lists.build(third, 7)
    assert lists.state() == (7, 7)
    same(lists, third)


def test_a_query_reads_the_files_of_its_rarest_key(spark, table, tmp_path):
    lists = Postings(spark, str(tmp_path / "lists"), table.schema)
    lists.build(table, 0)
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    found = lists.matching("doc tar", None, table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    # Folders of one key in one version, and no scan of the catalog.
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+", plan) and plan.count("FileScan") == 1
    assert "lists/tokens" in plan and "EqualTo(key,tar)" in plan and found.count() > 0
    assert lists._rarest("tokens", ["doc", "tar"], 0, 0) == "tar" and lists._rarest("tokens", ["doc", "nothing"], 0, 0) is None


def test_the_catalog_keeps_its_lists(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("server-error.log", "server.zip", "other.log"):
        (tmp_path / "in" / name).write_bytes(b"x")
    store = api.open_catalog(spark, str(tmp_path / "catalog"))
    api.build_catalog(store, [str(tmp_path / "in")])
    lists = api.build_postings(store, str(tmp_path / "lists"))
    find = lambda query: sorted(r.name for r in api.search(store.read(), query, postings=lists).items.collect())
    assert find("server") == ["server-error.log", "server.zip"]
    (tmp_path / "in" / "server-new.log").write_bytes(b"y")
    (tmp_path / "in" / "server.zip").unlink()
    before = store.version()
    api.refresh_root(store, str(tmp_path / "in"))
    api.update_postings(store, lists, before)
    assert find("server") == ["server-error.log", "server-new.log"] and find("in/other") == ["other.log"]
    assert lists.state() == (0, store.version())
