"""Node trees kept current: a batch of journal records resolves only what it touches.

For every directory a cache holds its *chain*: the directories from itself up to where its state is
decided, which is a directory at the root, a reparse point, a parent that is missing, or a cycle.  A
directory is affected by a batch only if a changed directory stands in its chain.  The nearest one
tells all: below it nothing has moved, so the new chain is the old one up to there and then that
directory's new chain.  Only the changed directories themselves are followed, from one to the next, by
pointer doubling; parents outside the batch are taken from the cache.

So work follows the batch and the subtrees below its directories.  The cache and the nodes are read
once each, without a shuffle, where the batch was counted and found small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.constants import ATTR_REPARSE
from logquarry.functions.classify import has_bits
from logquarry.operators.changes import last_per_key, node_log
from logquarry.operators.nodes import _follow, is_directory, is_root_reference, latest_records
from logquarry.operators.roots import without_excluded
from logquarry.plans.skew import BROADCAST_ROWS
from logquarry.session import materialize, materialize_counting

LINK = "struct<id:bigint,name:string>"
DIR_CACHE = f"id bigint, status string, stop bigint, chain array<{LINK}>"
RECORD = ["parent_id", "name", "attributes", "seq"]


def suffix_of(chain: Column) -> Column:
    """The path that a chain of an unbroken branch spells, from the root down."""
    parts = F.transform(F.reverse(chain), lambda x: F.when(x["name"] == "", "").otherwise(F.concat(F.lit("\\"), x["name"])))
    return F.array_join(parts, "")


def _link(node_id: Column, name: Column | None = None) -> Column:
    return F.struct(node_id.cast("bigint").alias("id"), (F.lit("") if name is None else name).alias("name"))


def _is_own_root() -> Column:
    """Does a directory stand at the root itself?"""
    return (F.col("id") == F.col("parent_id")) | (F.col("name") == ".") | is_root_reference(F.col("id"))


def _own_link() -> Column:
    """A directory in its chain; one at the root itself has no name there."""
    return _link(F.col("id"), F.when(_is_own_root(), "").otherwise(F.col("name")))


def _own_status() -> Column:
    """The state that a directory has whatever its parent's is, else null."""
    return (
        F.when(is_root_reference(F.col("id")), F.lit("ok"))
        .when(has_bits(F.col("attributes"), ATTR_REPARSE), F.lit("reparse"))
        .when(_is_own_root() | is_root_reference(F.col("parent_id")), F.lit("ok"))
    )


def directory_cache(nodes: DataFrame) -> DataFrame:
    """``id, status, stop, chain`` of every directory, by a full resolve."""
    dirs, _ = materialize_counting(latest_records(nodes).where(is_directory(F.col("attributes"))), "cache_dirs", n=F.count(F.lit(1)))
    known = dirs.select(F.col("id").alias("parent_id"), F.lit(True).alias("_known"))
    linked = dirs.join(known, "parent_id", "left")
    status = F.coalesce(_own_status(), F.when(F.col("_known").isNull(), F.lit("orphan")))
    lost = F.array(_own_link(), _link(F.col("parent_id")))
    chain = F.when(status == "orphan", lost).otherwise(F.array(_own_link()))
    state = linked.select("id", F.col("parent_id").alias("up"), F.lit("").alias("suffix"), status.alias("status"), chain.alias("chain"))
    return _follow(state, "cache").select("id", "status", "stop", "chain")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` hinted for broadcast where its counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _touched(nodes: DataFrame, records: DataFrame) -> tuple[DataFrame, int]:
    """``id, old, new`` of the ids that a batch changes; ``new`` is null where it deletes one."""
    fields = F.struct(*RECORD)
    batch = last_per_key(node_log(records.select("id", *RECORD).limit(0), records), ["id"])
    batch = batch.select("id", "seq", F.when(~F.col("gone"), fields).alias("new"))
    batch, seen = materialize_counting(batch, "batch_records", n=F.count(F.lit(1)))
    old = nodes.join(_small(batch.select("id"), seen["n"]), "id", "left_semi").select("id", fields.alias("old"))
    both = batch.join(old, "id", "left").where(F.col("old").isNull() | (F.col("seq") > F.col("old.seq")))
    touched, seen = materialize_counting(both.select("id", "seq", "old", "new"), "touched_nodes", n=F.count(F.lit(1)))
    return touched, seen["n"]


def _is_dir(record: str) -> Column:
    return F.coalesce(is_directory(F.col(f"{record}.attributes")), F.lit(False))


def _below(dirs: DataFrame, changed: DataFrame, n_changed: int) -> tuple[DataFrame, int]:
    """``id, low, below, near``: affected directories, the part of their chains below the nearest changed one, and that."""
    places = dirs.select("id", "chain", F.posexplode(F.col("chain.id")).alias("pos", "near"))
    met = places.join(_small(changed.select(F.col("id").alias("near")), n_changed), "near")
    nearest = met.groupBy("id").agg(F.min_by(F.struct("pos", "near", "chain"), "pos").alias("m"))
    below = F.slice("m.chain", F.lit(1), F.col("m.pos"))
    rows = nearest.select("id", below.alias("below"), F.col("m.near").alias("near"))
    rows, seen = materialize_counting(rows, "affected_dirs", n=F.count(F.lit(1)))
    return rows, seen["n"]


def _changed_state(changed: DataFrame, below: DataFrame, dirs: DataFrame, n_changed: int) -> DataFrame:
    """``id, status, stop, chain`` of the changed directories that are directories now."""
    now = changed.where("now_dir").select("id", "new.*")
    is_now = changed.select(F.col("id").alias("parent_id"), F.col("now_dir").alias("_changed"))
    near = below.select(F.col("id").alias("parent_id"), F.col("below").alias("_below"), F.col("near").alias("_near"))
    near_now = changed.select(F.col("id").alias("_near"), F.col("now_dir").alias("_near_now"))
    parents = now.select("parent_id").distinct()
    cached = dirs.withColumnRenamed("id", "parent_id").join(_small(parents, n_changed), "parent_id", "left_semi")
    cached = cached.select("parent_id", F.col("status").alias("_status"), F.col("stop").alias("_stop"), F.col("chain").alias("_chain"))
    rows = now.join(is_now, "parent_id", "left").join(near, "parent_id", "left").join(near_now, "_near", "left").join(cached, "parent_id", "left")

    own, inside = F.array(_own_link()), F.col("_changed").isNull() & F.col("_near").isNotNull()
    outside = F.col("_changed").isNull() & F.col("_near").isNull()
    orphan = F.lit("orphan")
    status = F.coalesce(
        _own_status(),
        F.when(F.col("_changed"), F.lit(None).cast("string"))
        .when(~F.col("_changed"), orphan)
        .when(inside & F.col("_near_now"), F.lit(None).cast("string"))
        .when(inside, orphan)
        .otherwise(F.coalesce("_status", orphan)),
    )
    settled = _own_status().isNotNull()
    up = F.when(inside, F.col("_near")).otherwise(F.col("parent_id"))
    chain = (
        F.when(settled, own)
        .when(F.col("_changed"), own)
        .when(inside & F.col("_near_now"), F.concat(own, "_below"))
        .when(inside, F.concat(own, "_below", F.array(_link(F.col("_near")))))
        .when(outside & F.col("_chain").isNotNull(), F.concat(own, "_chain"))
        .otherwise(F.concat(own, F.array(_link(F.col("parent_id")))))
    )
    # The directory without a parent: the last one below what is gone.
    stop = (
        F.when(~settled & inside & ~F.coalesce("_near_now", F.lit(False)), F.element_at("_below", -1)["id"])
        .when(~settled & outside & (F.col("_status") != "ok"), F.col("_stop"))
        .otherwise(F.col("id"))
    )
    low = F.least(F.col("id"), F.coalesce(F.when(~settled & inside, F.array_min(F.col("_below.id"))), F.col("id")))
    state = rows.select("id", up.alias("up"), F.lit("").alias("suffix"), status.alias("status"), stop.alias("stop"), low.alias("low"), chain.alias("chain"))
    return _follow(state, "changed_dirs").select("id", "status", "stop", "chain")


def tree_delta(
    nodes: DataFrame, dirs: DataFrame, records: DataFrame, root: str, exclusions: list[str] = ()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What one batch of records changes: node rows, rows of the directory cache, and file rows, each with ``gone``.

    ``nodes`` holds each id once, ``dirs`` is the cache before the batch.  Records not newer than a
    node change nothing.  A file is gone when it was affected and has no path after the batch.
    """
    root = root.rstrip("\\/")
    touched, n_touched = _touched(nodes, records)
    changed = touched.select("id", "new", _is_dir("old").alias("was_dir"), _is_dir("new").alias("now_dir")).where("was_dir OR now_dir")
    below, n_below = _below(dirs, changed, n_touched)
    new_state = _changed_state(changed, below, dirs, n_touched)

    # Affected directories that are not changed themselves hang on the nearest one that is.
    at = new_state.select(F.col("id").alias("near"), F.col("status").alias("_status"), F.col("stop").alias("_stop"), F.col("chain").alias("_chain"))
    hanging = below.where(F.col("id") != F.col("near")).join(at, "near", "left")
    kept = F.col("_status").isNotNull()
    moved = hanging.select(
        "id",
        F.coalesce("_status", F.lit("orphan")).alias("status"),
        F.when(~kept, F.element_at("below", -1)["id"]).when(F.col("_status") == "ok", F.col("id")).otherwise(F.col("_stop")).alias("stop"),
        F.when(kept, F.concat("below", "_chain")).otherwise(F.concat("below", F.array(_link(F.col("near"))))).alias("chain"),
    )
    # In a cycle the part below ends where it began.
    moved = moved.withColumn("chain", F.when(F.col("status") == "cyclic", F.array_distinct("chain")).otherwise(F.col("chain")))
    lost = changed.where("NOT now_dir").join(dirs.select("id"), "id", "left_semi")
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("status", "string"), ("stop", "bigint"), ("chain", f"array<{LINK}>"))]
    dir_rows = new_state.unionByName(moved).withColumn("gone", F.lit(False)).unionByName(lost.select("id", *none, F.lit(True).alias("gone")))
    dir_rows = materialize(dir_rows, "dir_delta")

    # Files of affected directories, and those that the batch names.
    over = _small(below.select("id").union(changed.select("id")).distinct().withColumnRenamed("id", "parent_id"), n_touched + n_below)
    files = nodes.where(~is_directory(F.col("attributes"))).select("id", "parent_id", "name")
    under = files.join(over, "parent_id", "left_semi").join(_small(touched.select("id"), n_touched), "id", "left_anti")
    named = touched.where(F.col("new").isNotNull() & ~_is_dir("new")).select("id", "new.parent_id", "new.name")
    candidates, seen = materialize_counting(under.unionByName(named), "affected_files", n=F.count(F.lit(1)))
    wanted = _small(candidates.select("parent_id").distinct(), seen["n"])
    ours = dir_rows.where(~F.col("gone")).select("id", "status", "chain")
    others = dirs.withColumnRenamed("id", "parent_id").join(wanted, "parent_id", "left_semi").withColumnRenamed("parent_id", "id")
    others = others.select("id", "status", "chain").join(dir_rows.select("id"), "id", "left_anti")
    table = ours.unionByName(others).where("status = 'ok'").select(F.col("id").alias("parent_id"), suffix_of(F.col("chain")).alias("suffix"))
    placed = candidates.join(table, "parent_id", "left")
    branch = F.when(is_root_reference(F.col("parent_id")), F.lit("")).otherwise(F.col("suffix"))
    path = F.concat(F.lit(root), branch, F.lit("\\"), F.col("name"))
    fresh = without_excluded(placed.select("id", path.alias("path")).where("path IS NOT NULL"), list(exclusions))
    fresh = materialize(fresh, "fresh_files")
    were = touched.where(F.col("old").isNotNull() & ~_is_dir("old")).select("id")
    left = candidates.select("id").union(were).distinct().join(fresh, "id", "left_anti")
    file_rows = fresh.withColumn("gone", F.lit(False)).unionByName(left.select("id", F.lit(None).cast("string").alias("path"), F.lit(True).alias("gone")))
    gone = F.col("new").isNull()
    # Of a deleted node only the id counts.
    record = F.coalesce("new", "old")
    node_rows = touched.select("id", *[record[c].alias(c) for c in RECORD if c != "seq"], "seq", gone.alias("gone"))
    return node_rows, dir_rows, file_rows
