from pyspark.sql import functions as F

from logquarry.operators import search as S
from logquarry.plans import views

SCHEMA = "path string, name string, size bigint, modified_ms bigint, is_log boolean, is_archive boolean"


def rows(spark, *items):
    return spark.createDataFrame([(p, p.replace("\\", "/").split("/")[-1], 1, None, log, arc) for p, log, arc in items], SCHEMA)


def test_name_type_and_paging(spark):
    table = rows(spark, ("D:\\work\\logs\\server-error.log", True, False), ("D:\\download\\server-backup.zip", True, True))
    found = S.search(table, "server", None, 0, 1)
    assert found.items.count() == 1 and found.stats.first().total == 2
    only = S.search(table, "server", "archive").items.collect()
    assert [r.kind for r in only] == ["archive"]
    assert S.search(table, "server", "log").stats.first().total == 1
    assert S.search(table, "   ").items.count() == 0


def test_token_search(spark):
    table = rows(
        spark, ("/l/DataPatchController.log", True, False), ("/l/debug.zip", False, True), ("/l/错误.log", True, False),
        ("/l/log.h", False, False), ("/l/debug.log", True, False),
    )
    assert [r.name for r in S.search(table, "data patch", "log").items.collect()] == ["DataPatchController.log"]
    assert [r.name for r in S.search(table, "debug.log").items.collect()] == ["debug.log"]
    assert [r.name for r in S.search(table, "错误").items.collect()] == ["错误.log"]
    assert S.search(table, "log").stats.first().total == 4
    assert S.search(S.with_search_columns(table), "debug").stats.first().total == 2


def test_rank_and_short_terms(spark):
    table = rows(spark, ("/z/xlog", True, False), ("/a/log-1", True, False), ("/b/log", True, False), ("/c/my-log", True, False))
    assert [r.name for r in S.search(table, "log").items.collect()] == ["log", "log-1", "my-log"]
    assert S.search(rows(spark, ("/Users/test/logs/api.log", True, False)), "/ap").stats.first().total == 1


def test_page_merge(spark):
    current = spark.createDataFrame([(1, "C:\\Logs\\app.log"), (2, "C:\\Logs\\server.log")], "n int, path string")
    incoming = spark.createDataFrame([(1, "c:/logs/APP.log"), (2, "C:\\Logs\\worker.log")], "n int, path string")
    merged = S.merge_pages(current, incoming, "n", 2).collect()
    assert [r.path for r in merged] == ["C:\\Logs\\app.log", "C:\\Logs\\server.log"]


def test_deep_page_equals_top_k(spark, sf, monkeypatch):
    table = views.catalog(spark, sf)
    near = [r.path for r in S.page(table, S.path_order(), 60, 40).collect()]
    monkeypatch.setattr(S, "TOP_K_ROWS", 10)
    deep = S.page(table, S.path_order(), 60, 40)
    assert sorted(near) == sorted(r.path for r in deep.collect())


def test_partitioning_does_not_change_results(spark, sf):
    table = views.catalog(spark, sf)
    one = [r.path for r in S.search(table.coalesce(1), "src1/ doc").items.collect()]
    many = [r.path for r in S.search(table.repartition(13), "src1/ doc").items.collect()]
    assert one == many and one


def test_page_is_a_top_k_and_filters_reach_the_scan(spark, sf):
    items = S.search(views.catalog(spark, sf), "/data/src1", "log", 100, 50).items
    plan = items._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string,n_chars:bigint>" in plan or "text" not in plan.split("ReadSchema")[1]


def test_trigram_candidates(spark, sf):
    table = views.catalog(spark, sf)
    grams = S.trigram_candidates(S.trigram_table(table), ["src1/en"])
    exact = table.where(S.has_substrings(["src1/en"]))
    assert exact.join(grams, "path", "left_anti").count() == 0
    assert exact.count() > 0
