import itertools
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from logquarry.operators import changes as H
from logquarry.operators import stability
from logquarry.session import work_path
from logquarry.sources.snapshots import Snapshots, usable
from logquarry.streaming import streams as ST
from logquarry.streaming.tables import BatchTable

EVENTS = "seq bigint, watch_dir string, op string, path string, old_path string, present boolean"


def events(spark, *items):
    rows = [(i, "/w", op, path, old, present) for i, (op, path, old, present) in enumerate(items)]
    return spark.createDataFrame(rows, EVENTS)


def changes(df):
    return sorted((r.op, r.path or "", r.old_path or "") for r in H.normalize_directory_events(df).collect())


def test_create_modify_rename_remove(spark):
    df = events(
        spark, ("create", "/w/a", None, True), ("modify", "/w/a", None, True), ("modify", "/w/old", None, True),
        ("rename", "/w/new", "/w/old", True), ("remove", "/w/gone", None, False), ("access", "/w/q", None, True),
        ("create", "/w/sub/deep", None, True), ("create", "/w/flash", None, False),
    )
    assert changes(df) == [("remove", "/w/gone", ""), ("rename", "/w/new", "/w/old"), ("upsert", "/w/a", "")]


@pytest.mark.parametrize(
    "item",
    [("rename_unpaired", "/w/x", None, True), ("modify", "/w/x", None, False), ("any", None, None, True), ("rename", "/w/n", "/w/o", False)],
)
def test_ambiguity_rescans_the_directory_only(spark, item):
    df = events(spark, ("create", "/w/a", None, True), item)
    other = spark.createDataFrame([(9, "/v", "create", "/v/k", None, True)], EVENTS)
    assert changes(df.unionByName(other)) == [("rescan", "", ""), ("upsert", "/v/k", "")]


def test_many_modifies_are_one_change(spark):
    many = spark.range(10_000).select(
        F.col("id").alias("seq"), F.lit("/w").alias("watch_dir"), F.lit("modify").alias("op"), F.lit("/w/a").alias("path"),
        F.lit(None).cast("string").alias("old_path"), F.lit(True).alias("present"),
    )
    assert changes(many) == [("upsert", "/w/a", "")]
    assert H.normalize_arrivals(many).count() == 1


def test_arrival_words(spark):
    df = events(
        spark, ("create", "/a", None, True), ("remove", "/a", None, True), ("create", "/b", None, True), ("rename", "/c", "/b", True),
        ("any", "/d", None, False), ("modify", "/e", None, True),
    )
    got = {r.path: r.action for r in H.normalize_arrivals(df).collect()}
    assert got == {"/a": "cancel", "/b": "cancel", "/c": "schedule", "/d": "cancel", "/e": "schedule"}
    assert H.is_degraded(df).first().degraded and not H.is_degraded(df.where("op <> 'any'")).first().degraded


def test_apply_directory_changes(spark):
    before = spark.createDataFrame([("/w", "/w/a", "x"), ("/w", "/w/b", None), ("/v", "/v/z", "y")], "watch_dir string, path string, children string")
    edits = spark.createDataFrame(
        [("/w", "rename", "/w/c", "/w/b"), ("/w", "upsert", "/w/a", None), ("/w", "remove", "/w/q", None)], "watch_dir string, op string, path string, old_path string"
    )
    none = before.limit(0).select("watch_dir", "path")
    after = {(r.watch_dir, r.path): r.children for r in H.apply_directory_changes(before, edits, none).collect()}
    assert after == {("/w", "/w/a"): "x", ("/w", "/w/c"): None, ("/v", "/v/z"): "y"}
    rescan = spark.createDataFrame([("/w", "rescan", None, None)], "watch_dir string, op string, path string, old_path string")
    listing = spark.createDataFrame([("/w", "/w/a"), ("/w", "/w/n")], "watch_dir string, path string")
    after = {(r.watch_dir, r.path): r.children for r in H.apply_directory_changes(before, rescan, listing).collect()}
    assert after == {("/w", "/w/a"): "x", ("/w", "/w/n"): None, ("/v", "/v/z"): "y"}


def test_source_prompts(spark):
    df = spark.createDataFrame(
        [("C:\\a.log", "modified", "r1", 1), ("c:/A.log", "modified", "r2", 2), ("C:\\A.LOG", "deleted", None, 3), ("C:\\a.log", "modified", "r3", 4)],
        "path string, kind string, revision string, seq bigint",
    )
    assert [(r.kind, r.revision) for r in H.source_prompts(df).collect()] == [("deleted", None)]
    assert [(r.kind, r.revision) for r in H.source_prompts(df.where("seq <> 3")).collect()] == [("modified", "r3")]


def test_path_events(spark):
    schema = "path string, size bigint"
    catalog = spark.createDataFrame([("/r/d/a", 1), ("/r/d/b", 1), ("/r/gone/x", 1), ("/r/k", 1)], schema)
    listing = spark.createDataFrame([("/r/d/a", 2), ("/r/d/new", 3), ("/r/k", 9), ("/r/no/p", 1)], schema)
    touched = spark.createDataFrame([("/r/d",), ("/r/gone",), ("/r/no",)], "path string")
    after = {r.path: r.size for r in H.apply_path_events(catalog, touched, listing, ["/r/no"]).collect()}
    assert after == {"/r/d/a": 2, "/r/d/b": 1, "/r/d/new": 3, "/r/k": 1}


NODES = "id bigint, parent_id bigint, name string, attributes int, seq bigint"
RECORDS = NODES + ", reason int"


def test_journal_rename_and_delete(spark):
    nodes = spark.createDataFrame([(5, 5, ".", 16, 1), (10, 5, "Logs", 16, 2), (11, 10, "app.log", 0, 3)], NODES)
    files = spark.createDataFrame([(11, "C:\\Logs\\app.log")], "id bigint, path string")
    renamed = spark.createDataFrame([(10, 5, "Old", 16, 9, 0x1000), (10, 5, "Renamed", 16, 10, 0x2000)], RECORDS)
    nodes, files = H.apply_journal(nodes, files, renamed, "C:")
    assert [r.path for r in files.collect()] == ["C:\\Renamed\\app.log"]
    again = H.apply_journal(nodes, files, renamed, "C:")[1]
    assert [r.path for r in again.collect()] == ["C:\\Renamed\\app.log"]
    gone = spark.createDataFrame([(11, 10, "app.log", 0, 11, 0x200)], RECORDS)
    assert H.apply_journal(nodes, files, gone, "C:")[1].count() == 0


def test_resume_rules(spark):
    state = spark.createDataFrame(
        [("ok", "v", "j", 5, True), ("id", "w", "j", 5, True), ("jid", "v", "k", 5, True), ("early", "v", "j", 1, True), ("late", "v", "j", 99, True), ("half", "v", "j", 5, False)],
        "root string, identity string, journal_id string, next_seq bigint, complete boolean",
    )
    info = spark.createDataFrame([(r, "v", "j", 2, 9) for r in ("ok", "id", "jid", "early", "late", "half", "new")], "root string, identity string, journal_id string, first_seq bigint, next_seq bigint")
    plan = H.resume_plan(state, info)
    assert {r.root for r in plan.where("resumable").collect()} == {"ok"}
    journal = spark.createDataFrame([("ok", s) for s in range(12)], "root string, seq bigint")
    records, rebuild = H.catch_up_records(journal, plan)
    assert sorted(r.seq for r in records.collect()) == [5, 6, 7, 8]
    assert rebuild.count() == 6
    records, rebuild = H.catch_up_records(journal, plan, limit=3)
    assert records.count() == 0 and rebuild.count() == 7


WAIT = "seq bigint, path string, op string, size bigint"


def waits(spark, *items):
    return spark.createDataFrame([(i, *item) for i, item in enumerate(items)], WAIT)


def done(spark, *items):
    return [(r.path, r.seq, r.size) for r in stability.arrivals(waits(spark, *items))[0].collect()]


def test_arrival_waits(spark):
    s = ("a", "sample", 5)
    assert done(spark, ("a", "schedule", None), s, s, s, s) == [("a", 4, 5)]
    assert done(spark, ("a", "schedule", None), s, s, s) == []
    assert done(spark, ("a", "schedule", None), s, s, ("a", "cancel", None), s, s, s, s) == []
    assert done(spark, ("a", "schedule", None), s, ("a", "schedule", None), s, s, s, s, s, s, s) == [("a", 6, 5)]
    growing = [("a", "sample", i) for i in range(30)]
    assert done(spark, ("a", "schedule", None), *growing) == [("a", 21, 20)]
    assert done(spark, s, s, s, s, s) == []


def test_waits_do_not_depend_on_batches(spark):
    rng = random.Random(5)
    items = [(f"p{rng.randrange(3)}", rng.choice(["schedule", "cancel"] + ["sample"] * 9), rng.randrange(2)) for _ in range(600)]
    whole = waits(spark, *items)
    expected = sorted(map(tuple, stability.arrivals(whole)[0].select("path", "seq", "size").collect()))
    assert expected
    for cuts in ([200, 400], [1, 7, 599]):
        out = BatchTable(spark, work_path(spark, "o"), "path string, seq bigint, size bigint")
        waiting = BatchTable(spark, work_path(spark, "w"), WAIT)
        handle = ST.stable_arrivals(out, waiting)
        for batch_id, (low, high) in enumerate(itertools.pairwise([0, *cuts, 600])):
            part = whole.where((F.col("seq") >= low) & (F.col("seq") < high))
            handle(part, batch_id)
            handle(part, batch_id)  # a batch may be replayed
        assert sorted(map(tuple, out.read().select("path", "seq", "size").collect())) == expected


def test_unread_rules(spark):
    def unread(*items, **options):
        df = spark.createDataFrame([(i, p, op) for i, (p, op) in enumerate(items)], "seq bigint, path string, op string")
        return sorted((r.path, r.seq) for r in ST.unread(ST.unread_facts(df), **options).collect())

    assert unread(("a", "arrive"), ("a", "arrive")) == [("a", 0)]
    assert unread(("a", "arrive"), ("a", "read"), ("a", "arrive")) == []
    assert unread(("a", "arrive"), ("a", "read"), ("a", "arrive"), repeat=True) == [("a", 2)]
    assert unread(("a", "read"), ("a", "arrive")) == []
    assert unread(("a", "remove"), ("a", "arrive")) == [("a", 1)]
    assert unread(("a", "arrive"), ("b", "arrive"), ("b", "remove"), ("c", "arrive"), all_read_at=2) == [("c", 3)]


def test_stream_restarts_from_its_checkpoint(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "ck")
    schema = "seq bigint, path string"
    out = BatchTable(spark, str(tmp_path / "out"), schema)
    fail = {"on": False}

    def handle(batch, batch_id):
        out.write(batch, batch_id)
        if fail["on"]:
            raise RuntimeError("lost")

    for low in (0, 10):
        spark.range(low, low + 10).select(F.col("id").alias("seq"), F.lit("p").alias("path")).write.mode("append").parquet(source)
        fail["on"] = low == 10
        stream = ST.event_stream(spark, source, schema)
        query = ST.run(stream, handle, checkpoint, True)
        if fail["on"]:
            with pytest.raises(StreamingQueryException):
                ST.finish(query)
            fail["on"] = False
            ST.finish(ST.run(ST.event_stream(spark, source, schema), handle, checkpoint, True))
        else:
            ST.finish(query)
    assert sorted(r.seq for r in out.read().collect()) == list(range(20))


def test_snapshots(spark, tmp_path):
    old = spark.createDataFrame([("stable-old.log",)], "path string")
    new = spark.createDataFrame([("replacement-new.log",)], "path string")
    store = Snapshots(spark, str(tmp_path / "c"), old.schema)
    assert store.read().count() == 0 and store.version() is None
    store.replace(old)
    built = store.build(new)
    assert [r.path for r in store.read().collect()] == ["stable-old.log"]
    store.switch(built)
    store.switch(built)
    fresh = Snapshots(spark, str(tmp_path / "c"), old.schema)
    assert [r.path for r in fresh.read().collect()] == ["replacement-new.log"]
    assert fresh.log().count() == 2
    assert [r.path for r in fresh.read(0).collect()] == ["stable-old.log"]
    fresh.clear()
    assert store.read().count() == 0
    assert usable(old, new, False).first().usable
    assert not usable(old, new.limit(0), True).first().usable


def test_upsert_is_idempotent(spark):
    schema = "path string, size bigint"
    catalog = spark.createDataFrame([("a", 5), ("b", 1)], schema)
    rows = spark.createDataFrame([("a", 9), ("c", 3)], schema)
    once = H.upsert(catalog, rows)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, H.upsert(once, rows).collect())) == [("a", 9), ("b", 1), ("c", 3)]
    assert sorted(map(tuple, H.insert_absent(catalog, rows).collect())) == [("a", 5), ("b", 1), ("c", 3)]


def test_notifications(spark):
    df = spark.createDataFrame(
        [(1, "/r/a.log", "a.log", False), (2, "/r//a.log", "a.log", False), (3, "/o/b.log", "b.log", False), (4, "/r/c.ZIP", "c.ZIP", True), (5, "/r/d.bin", "d.bin", False)],
        "seq bigint, path string, name string, is_archive boolean",
    )
    assert sorted(r.path for r in ST.notifications(df, ["/r", "/r/x"], [".LOG"]).collect()) == ["/r/a.log", "/r/c.ZIP"]
    assert ST.notifications(df, ["/r"], [], True).count() == 3
