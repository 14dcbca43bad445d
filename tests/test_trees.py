"""Trees kept current batch by batch against a full resolve of the nodes after each batch."""

import random

import pytest
from pyspark.sql import functions as F

from logquarry.operators import changes as H
from logquarry.operators import nodes as N
from logquarry.operators import trees as T
from logquarry.streaming import streams as ST
from logquarry.streaming.tables import BatchTable

NODES = "id bigint, parent_id bigint, name string, attributes int, seq bigint"
RECORDS = f"{NODES}, reason int"
CREATE, RENAME, DELETE = 0x100, 0x2000, 0x200
DIR, REPARSE = 0x10, 0x410


def tree(rng, n):
    rows = [(5, 5, ".", DIR, 0)]
    for i in range(6, n):
        kind = rng.choice([DIR, DIR, 0, 0, REPARSE if rng.random() < 0.2 else 0])
        parent = rng.choice([5, rng.randrange(6, max(7, i)), rng.randrange(6, n + 4), rng.randrange(6, max(7, i))])
        rows.append((i, parent, f"n{i}", kind, 0))
    # A cycle, a directory that is its own parent, and one below a missing one.
    return [*rows, (n + 10, n + 11, "x", DIR, 0), (n + 11, n + 10, "y", DIR, 0), (n + 12, n + 12, "own", DIR, 0), (n + 13, n + 99, "lost", DIR, 0)]


def batch(rng, n, seq, size):
    out = []
    for k in range(size):
        i = rng.randrange(6, n + 15)
        reason = rng.choice([CREATE, RENAME, RENAME, DELETE])
        kind = rng.choice([DIR, DIR, DIR, 0, REPARSE])
        out.append((i, rng.choice([5, rng.randrange(6, n + 15), rng.randrange(6, n + 15)]), f"s{seq + k}", kind, seq + k, reason))
    return out


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_batches_against_a_full_resolve(spark, tmp_path, seed):
    rng = random.Random(seed)
    n = 60
    first = spark.createDataFrame(tree(rng, n), NODES)
    begun = N.resolve_files(first, "C:")
    nodes = BatchTable(spark, str(tmp_path / "nodes"), ST.NODE_LOG, first.withColumn("gone", F.lit(False)), fold_every=2)
    dirs = BatchTable(spark, str(tmp_path / "dirs"), ST.DIR_LOG, T.directory_cache(first).withColumn("gone", F.lit(False)), fold_every=2)
    files = BatchTable(spark, str(tmp_path / "files"), ST.FILE_LOG, begun.entries.select("id", "path", F.lit(False).alias("gone")))
    handle = ST.journal_updates(nodes, dirs, files, "C:", ["C:\\n8"])
    plain, seq = first, 1
    for number, size in enumerate((12, 1, 3, 12)):
        records = batch(rng, n, seq, size)
        # Some records are older than what is known.
        stale = [(i, p, "old", a, 0, r) for i, p, _, a, _, r in records[:1]]
        df = spark.createDataFrame([*records, *stale], RECORDS)
        seq += size
        handle(df, number)
        if number == 2:  # a batch that is played again
            handle(df, number)
        plain = spark.createDataFrame(H.apply_records(plain, df).collect(), NODES)
        full = N.resolve_files(plain, "C:")
        live = nodes.state(["id"], number + 1).where("NOT gone")
        assert rows_of(live, "id", "parent_id", "name", "attributes", "seq") == rows_of(plain, "id", "parent_id", "name", "attributes", "seq")
        cache = dirs.state(["id"], number + 1).where("NOT gone")
        got = rows_of(cache, "id", "status", F.when(F.col("status") != "ok", F.col("stop")).alias("stop"))
        assert got == rows_of(full.directories, "id", "status", F.when(F.col("status") != "ok", F.col("stop")).alias("stop"))
        expected = full.entries.where(~F.startswith("path", F.lit("C:\\n8\\"))).select("id", "path")
        assert rows_of(ST.live_files(files).where(~F.startswith("path", F.lit("C:\\n8\\"))), "id", "path") == rows_of(expected, "id", "path")
    # Chains of the cache lead where those of a new cache lead.
    sets = F.array_sort(F.col("chain.id")).alias("chain")
    assert rows_of(cache, "id", sets) == rows_of(T.directory_cache(plain), "id", sets)


def test_work_follows_the_batch(spark, tmp_path):
    """Few jobs, and no row of the deltas outside the renamed directory."""
    rows = [(5, 5, ".", DIR, 0)] + [(100 + d, 5 if d < 10 else 100 + d // 10, f"d{d}", DIR, 0) for d in range(1, 1000)]
    rows += [(10_000 + f, 100 + f % 1000 or 101, f"f{f}", 0, 0) for f in range(1, 5000)]
    first = H.last_per_key(spark.createDataFrame(rows, NODES), ["id"])
    first.write.parquet(str(tmp_path / "nodes"))
    T.directory_cache(first).write.parquet(str(tmp_path / "dirs"))
    nodes, dirs = spark.read.parquet(str(tmp_path / "nodes")), spark.read.parquet(str(tmp_path / "dirs"))
    records = spark.createDataFrame([(112, 101, "renamed", DIR, 9, RENAME)], RECORDS)
    node_rows, dir_rows, file_rows = T.tree_delta(nodes, dirs, records, "C:")
    inside = {112} | {100 + d for d in range(1, 1000) if str(d).startswith("12")}
    assert {r.id for r in dir_rows.collect()} == inside and node_rows.count() == 1
    assert {r.id for r in file_rows.collect()} == {i for i, p, _, a, _ in rows if not a and p in inside}
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("tree", "one batch")
    try:
        for df in T.tree_delta(nodes, dirs, records, "C:"):
            df.write.format("noop").mode("overwrite").save()
        jobs = len(tracker.getJobIdsForGroup("tree"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 60
