import random
import re

import pytest
from pyspark.sql import functions as F

from logquarry.operators import nodes as N
from logquarry.operators import roots as R
from logquarry.plans import skew
from logquarry.streaming.streams import event_stream

NODES = "id bigint, parent_id bigint, name string, attributes int, seq bigint"
DIR = 0x10


def nodes(spark, *items):
    return spark.createDataFrame([(*item, i) for i, item in enumerate(items)], NODES)


def paths(df):
    return sorted(r.path for r in df.collect())


def test_most_specific_root_both_ways(spark, monkeypatch):
    files = spark.createDataFrame([("/a/b/x",), ("/a/y",), ("/ab/z",), ("C:\\Logs\\q.log",), ("/a",)], "path string")
    roots = ["/a", "/a/b", "c:/logs", "/ab/"]
    inline = {r.path: r.root for r in R.with_root(files, roots).collect()}
    assert inline == {"/a/b/x": "/a/b", "/a/y": "/a", "/ab/z": "/ab/", "C:\\Logs\\q.log": "c:/logs", "/a": "/a"}
    monkeypatch.setattr(R, "INLINE_ROOTS", 0)
    assert {r.path: r.root for r in R.with_root(files, roots).collect()} == inline
    assert paths(R.without_excluded(files, ["/a"])) == ["/ab/z", "C:\\Logs\\q.log"]
    assert paths(R.without_subtree(files, ["/a/b"])) == ["/a", "/a/y", "/ab/z", "C:\\Logs\\q.log"]


def test_spellings_and_blank_roots_both_ways(spark, monkeypatch):
    files = spark.createDataFrame([("C:/logs/a.log",), ("/x/y",)], "path string")
    roots = ["C:\\Logs", "c:/logs", "", " "]
    expected = {"C:/logs/a.log": "C:\\Logs", "/x/y": None}
    for order in (roots, roots[::-1]):
        assert {r.path: r.root for r in R.with_root(files, order).collect()} == expected
        with monkeypatch.context() as patch:
            patch.setattr(R, "INLINE_ROOTS", 0)
            assert {r.path: r.root for r in R.with_root(files, order).collect()} == expected


def random_paths(rng, n, deepest):
    """Paths of few names, so that many lie inside one another, of both platforms and odd spellings."""
    out = []
    for _ in range(n):
        anchor = rng.choice(["/", "/", "/", "C:\\", "d:/", ""])
        parts = [rng.choice("abA") + rng.choice(["", "1", "22"]) for _ in range(rng.randint(0, deepest))]
        sep = "\\" if anchor == "C:\\" and rng.random() < 0.7 else "/"
        out.append(anchor + sep.join(parts) + rng.choice(["", "", sep, "//"]))
    return out


def holder(path, keyed):
    """The most specific root by trying every prefix; of two spellings the smaller."""
    key = plain_key(path)
    best = [(len(k), k) for k in keyed if key == k or key.startswith(k if k.endswith("/") else k + "/")]
    return keyed[max(best)[1]] if best else None


def plain_key(path):
    windows = re.match(r"[A-Za-z]:[/\\]", path)
    key = re.sub(r"[/\\]+", "/", path)
    if len(key) > (3 if windows else 1) and key.endswith("/"):
        key = key[:-1]
    return key.lower() if windows else key


@pytest.mark.parametrize("many", [3, 65, 10_000])
def test_roots_of_any_number_are_found_as_by_the_list(spark, monkeypatch, many):
    rng = random.Random(many)
    roots = [r for r in random_paths(rng, 2 * many, 9) if r.strip()][:many]
    keyed = {}
    for r in sorted(roots, reverse=True):
        keyed[plain_key(r)] = r
    files = [*random_paths(rng, 1500, 12), "/", "C:\\", "", *roots[:50]]
    df = spark.createDataFrame([(p, i, "x") for i, p in enumerate([*files, files[0]])] + [(None, -1, "x")], "path string, n int, root string")
    monkeypatch.setattr(R, "INLINE_ROOTS", 0)
    got = R.with_root(df, roots)
    assert got.columns == ["path", "n", "root"]
    found = {r.n: (r.path, r.root) for r in got.collect()}
    assert len(found) == len(files) + 2
    assert found == {i: (p, holder(p, keyed)) for i, p in enumerate([*files, files[0]])} | {-1: (None, None)}
    kept = R.without_excluded(df, roots)
    assert kept.columns == df.columns
    assert {r.n for r in kept.collect()} == {i for i, (_, root) in found.items() if root is None}
    if many <= 65:
        monkeypatch.setattr(R, "INLINE_ROOTS", 64)
        table = spark.createDataFrame([(r,) for r in roots], "root string")
        assert {r.n: (r.path, r.root) for r in R.with_root(df, table).collect()} == found
    inner = {k for k in keyed if any(k != o and k.startswith(o if o.endswith("/") else o + "/") for o in keyed)} if many <= 65 else None
    if inner is not None:
        least = R.minimal_roots(spark.createDataFrame([(r,) for r in roots], "root string"))
        assert sorted(plain_key(r.root) for r in least.collect()) == sorted(set(keyed) - inner)


@pytest.mark.parametrize("small", [True, False])
def test_the_search_repeats_no_path_and_shuffles_little(spark, monkeypatch, tmp_path, small):
    monkeypatch.setattr(R, "INLINE_ROOTS", 0)
    spark.createDataFrame([(p,) for p in random_paths(random.Random(1), 300, 8)], "path string").write.parquet(str(tmp_path / "paths"))
    files = spark.read.parquet(str(tmp_path / "paths"))
    roots = [f"/a/b{'/c' * (i % 7)}/r{i}" for i in range(500)]
    expected = sorted(R.with_root(files, roots).collect(), key=repr)
    if not small:
        monkeypatch.setattr(R, "checked_broadcast", lambda table: None)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = R.with_root(files, roots)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert sorted(found.collect(), key=repr) == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Seven depths: three probes, each a join; rows of paths are never generated.
    assert "Generate" not in plan and plan.count("Join") == 3
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == (0 if small else 6)


def test_a_stream_takes_any_number_of_roots(spark, tmp_path):
    events = spark.createDataFrame([(f"/r{i}/f.log",) for i in range(0, 200, 2)], "path string")
    events.write.parquet(str(tmp_path / "events"))
    roots = [f"/r{i}" for i in range(70)]
    found = event_stream(spark, str(tmp_path / "events"), events.schema, roots, ["/r4"])
    query = found.writeStream.format("memory").queryName("many_roots").trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "checkpoint")).start().awaitTermination()
    got = {r.path for r in spark.table("many_roots").collect()}
    assert got == {f"/r{i}/f.log" for i in range(0, 70, 2)} - {"/r4/f.log"}


def test_root_algebra(spark):
    roots = spark.createDataFrame([("/a/b",), ("/a",), ("/ab",), ("/a/b/c",)], "root string")
    assert sorted(r.root for r in R.minimal_roots(roots).collect()) == ["/a", "/ab"]
    added = {r.root: r.added for r in R.add_root(R.minimal_roots(roots), "/").collect()}
    assert added == {"/": True}
    same = {r.root: r.added for r in R.add_root(roots, "/a/b/z").collect()}
    assert len(same) == 4 and not any(same.values())
    blanks = spark.createDataFrame([(" private ", 1), ("", 2), ("private", 3)], "path string, n int")
    assert [tuple(r) for r in R.distinct_paths(blanks, "path", "n").collect()] == [("private", 1)]


def test_hot_keys_are_spread_without_changing_the_join(spark, monkeypatch):
    rows = spark.range(2000).select(F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    table = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 7).alias("v"))
    plain = sorted(map(tuple, rows.join(table, "k", "left").select("n", "k", "v").collect()))
    monkeypatch.setattr(skew, "checked_broadcast", lambda df, rows=0: None)
    for how in ("left", "inner", "left_anti", "left_semi"):
        salted = skew.lookup_join(rows, table, "k", how, hot_rows=100)
        expected = rows.join(table, "k", how)
        cols = sorted(expected.columns)
        assert sorted(map(tuple, salted.select(cols).collect()), key=str) == sorted(map(tuple, expected.select(cols).collect()), key=str)
    assert skew.hot_values(rows, "k", 100) == [0]
    assert len(plain) == 2000


def test_out_of_order_and_orphan(spark):
    table = nodes(spark, (30, 20, "debug.log", 0), (5, 5, ".", DIR), (20, 5, "Logs", DIR), (40, 99, "orphan.log", 0))
    tree = N.resolve_files(table, "C:\\")
    assert paths(tree.entries) == ["C:\\Logs\\debug.log"]
    assert N.diagnostics(table, tree).first().orphan == 1


def test_reparse_branch(spark):
    table = nodes(
        spark, (5, 5, ".", DIR), (10, 5, "Logs", DIR), (11, 10, "app.log", 0), (20, 5, "Junction", DIR | 0x400), (21, 20, "x.log", 0),
    )
    tree = N.resolve_files(table, "C:")
    assert paths(tree.entries) == ["C:\\Logs\\app.log"]
    facts = N.diagnostics(table, tree).first().asDict()
    assert facts == {"orphan": 0, "cyclic": 0, "duplicate": 0, "reparse": 1}


def test_cycles_are_counted_once_each(spark):
    ring = [(100 + i, 100 + (i + 1) % 7, f"r{i}", DIR) for i in range(7)]
    pair = [(200, 201, "p", DIR), (201, 200, "q", DIR), (202, 200, "tail", DIR), (203, 202, "lost.log", 0)]
    table = nodes(spark, (1, 1, "root", DIR), *ring, *pair, (110, 103, "in.log", 0), (2, 1, "ok.log", 0), (2, 1, "again.log", 0))
    tree = N.resolve_files(table, "C:")
    assert paths(tree.entries) == ["C:\\again.log"]
    facts = N.diagnostics(table, tree).first().asDict()
    assert facts == {"orphan": 0, "cyclic": 2, "duplicate": 1, "reparse": 0}


def climb(table, root="C:"):
    """Brute force: walk up from every file."""
    found = {}
    for node in table.values():
        if node["attributes"] & DIR:
            continue
        parts, cur, seen = [node["name"]], node["parent_id"], set()
        while True:
            if cur & ((1 << 48) - 1) == 5:
                found[node["id"]] = "\\".join([root, *reversed(parts)])
                break
            up = table.get(cur)
            if up is None or not up["attributes"] & DIR or up["attributes"] & 0x400 or cur in seen:
                break
            seen.add(cur)
            if up["id"] == up["parent_id"] or up["name"] == ".":
                found[node["id"]] = "\\".join([root, *reversed(parts)])
                break
            parts.append(up["name"])
            cur = up["parent_id"]
    return found


def test_random_trees_match_brute_force(spark):
    rng = random.Random(7)
    items = [(1, 1, ".", DIR)]
    for i in range(2, 400):
        kind = rng.choice([DIR, DIR, 0, 0, DIR | 0x400 if rng.random() < 0.1 else DIR])
        items.append((i, rng.randrange(1, 420) if rng.random() < 0.2 else rng.randrange(max(1, i - 6), i), f"n{i}", kind))
    table = {i[0]: dict(zip(("id", "parent_id", "name", "attributes"), i)) for i in items}
    got = {r.id: r.path for r in N.resolve_files(nodes(spark, *items), "C:").entries.collect()}
    assert got == climb(table)
    changed = {i for i in range(2, 400, 37)}
    marks = spark.createDataFrame([(i, bool(table[i]["attributes"] & DIR)) for i in changed], "id bigint, is_dir boolean")
    affected = {r.id for r in N.affected_files(N.latest_records(nodes(spark, *items)), marks).collect()}
    expected = set()
    for node in table.values():
        if node["attributes"] & DIR:
            continue
        cur, seen = node["parent_id"], set()
        hit = node["id"] in changed
        while not hit and cur not in seen:
            seen.add(cur)
            if cur in changed and table[cur]["attributes"] & DIR:
                hit = True
            elif cur not in table or table[cur]["parent_id"] == cur:
                break
            else:
                cur = table[cur]["parent_id"]
        if hit:
            expected.add(node["id"])
    assert affected == expected


def test_all_entries_follow_reparse_points(spark):
    table = nodes(spark, (1, 1, "root", DIR), (2, 1, "J", DIR | 0x400), (3, 2, "a", 0), (4, 3, "b", 0), (9, 8, "x", 0))
    assert paths(N.resolve_all(table, "C:\\")) == ["C:\\J", "C:\\J\\a", "C:\\J\\a\\b"]
