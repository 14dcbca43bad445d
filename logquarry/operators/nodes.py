"""Node trees: full paths, affected files and diagnostics from parent ids.

Parents are followed by pointer doubling: in every round a node takes over its
ancestor's ancestor, so a tree of depth ``d`` needs about ``log2(d)`` equi joins
however large it is.  A round in which nothing is settled proves that what is
left runs in circles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.constants import ATTR_DIRECTORY, ATTR_REPARSE, ROOT_FILE_NUMBER
from logquarry.functions.classify import has_bits
from logquarry.plans.skew import lookup_join
from logquarry.session import materialize_counting


def latest_records(nodes: DataFrame) -> DataFrame:
    """One record per id: the last one by ``seq``, combined before the shuffle."""
    fields = F.struct("parent_id", "name", "attributes", "seq")
    return nodes.groupBy("id").agg(F.max_by(fields, "seq").alias("r")).select("id", "r.*")


def is_directory(attributes: Column) -> Column:
    """Is the directory bit set?"""
    return has_bits(attributes, ATTR_DIRECTORY)


def is_root_reference(node_id: Column) -> Column:
    """Does the id name the well-known root record?

    The lower 48 bits of a reference are the record number.
    """
    return node_id.bitwiseAND(F.lit((1 << 48) - 1)) == ROOT_FILE_NUMBER


@dataclass(frozen=True)
class ResolvedTree:
    """Resolved entries and the state of every directory."""

    entries: DataFrame
    directories: DataFrame


def _follow(state: DataFrame, name: str) -> DataFrame:
    """Settle ``state(id, up, suffix, status)`` by pointer doubling.

    ``status`` is null while ``up`` still has to be followed.  Settled rows are
    kept aside, so later rounds carry only the open ones.  ``stop`` becomes the
    directory at which a broken branch breaks, or one fixed member of its cycle;
    ``low`` is the smallest id between a node and its pointer.  Both begin as the
    id where the state does not bring them.  A column ``chain``, an array of what
    lies between a node and its pointer, grows with the pointer.
    """
    begun = state.withColumns({c: F.col("id") for c in ("stop", "low") if c not in state.columns})
    extra = ["chain"] if "chain" in state.columns else []
    is_open = F.count_if(F.col("status").isNull())
    state, seen = materialize_counting(begun, name, open=is_open)
    open_rows = seen["open"]
    while open_rows:
        settled = state.where(F.col("status").isNotNull())
        waiting = state.where(F.col("status").isNull())
        above = state.select(
            F.col("id").alias("up"),
            F.col("up").alias("_up"),
            F.col("suffix").alias("_suffix"),
            F.col("status").alias("_status"),
            F.col("stop").alias("_stop"),
            F.col("low").alias("_low"),
            *[F.col(c).alias(f"_{c}") for c in extra],
        )
        broken = F.coalesce(~F.col("_status").isin("ok"), F.lit(False))
        moved = lookup_join(waiting.drop("stop"), above, "up", "left", F.col("id"), n_rows=open_rows).select(
            "id",
            F.col("_up").alias("up"),
            F.when(broken, F.col("suffix")).otherwise(F.concat("_suffix", "suffix")).alias("suffix"),
            F.col("_status").alias("status"),
            F.when(broken, F.col("_stop")).otherwise(F.col("id")).alias("stop"),
            F.least("low", "_low").alias("low"),
            *[F.concat(c, f"_{c}").alias(c) for c in extra],
        )
        state, seen = materialize_counting(settled.unionByName(moved), name, open=is_open)
        left = seen["open"]
        if left == open_rows:
            return _name_cycles(state, left, name)
        open_rows = left
    return state


def _name_cycles(state: DataFrame, count: int, name: str) -> DataFrame:
    """Mark what is left as cyclic and name each cycle by its smallest id.

    A node's name is the smallest id seen from its pointer's target.  Once a
    round changes neither smallest ids nor names, every pointer's path has gone
    all the way round its cycle.
    """
    ring = state.where(F.col("status").isNull())
    extra = ["chain"] if "chain" in state.columns else []
    links = ring.select("id", "up", "low", F.lit(None).cast("bigint").alias("stop"), *extra)
    changed = 1
    while changed:
        above = links.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("low").alias("_low"), *[F.col(c).alias(f"_{c}") for c in extra])
        moved = lookup_join(links, above, "up", "inner", F.col("id"), n_rows=count).select(
            "id",
            F.col("_up").alias("up"),
            F.least("low", "_low").alias("low"),
            F.col("_low").alias("stop"),
            ((F.col("_low") < F.col("low")) | F.col("stop").isNull() | (F.col("stop") != F.col("_low"))).alias("_new"),
            *[F.array_distinct(F.concat(c, f"_{c}")).alias(c) for c in extra],
        )
        written, seen = materialize_counting(moved, name, changed=F.count_if("_new"))
        links, changed = written.drop("_new"), seen["changed"]
    named = links.select("id", "stop", *extra)
    cyclic = ring.drop("stop", "status", *extra).join(named, "id").withColumn("status", F.lit("cyclic"))
    return state.where(F.col("status").isNotNull()).unionByName(cyclic.select(*state.columns))


def _records(nodes: DataFrame) -> tuple[DataFrame, int]:
    """The last record of each id, written once, and their number."""
    records, seen = materialize_counting(latest_records(nodes), "node_records", n=F.count(F.lit(1)))
    return records, seen["n"]


def _directory_state(records: DataFrame, n_rows: int) -> DataFrame:
    """First state of every directory of the files-only rule set."""
    dirs = records.where(is_directory(F.col("attributes")))
    known = dirs.select(F.col("id").alias("parent_id"), F.lit(True).alias("_known"))
    linked = lookup_join(dirs, known, "parent_id", "left", F.col("id"), n_rows=n_rows)
    itself = (F.col("id") == F.col("parent_id")) | (F.col("name") == ".") | is_root_reference(F.col("id"))
    under_root = is_root_reference(F.col("parent_id"))
    status = (
        F.when(is_root_reference(F.col("id")), F.lit("ok"))
        .when(has_bits(F.col("attributes"), ATTR_REPARSE), F.lit("reparse"))
        .when(itself, F.lit("ok"))
        .when(under_root, F.lit("ok"))
        .when(F.col("_known").isNull(), F.lit("orphan"))
    )
    suffix = F.when(itself, F.lit("")).otherwise(F.concat(F.lit("\\"), F.col("name")))
    return linked.select("id", F.col("parent_id").alias("up"), suffix.alias("suffix"), status.alias("status"))


def resolve_files(nodes: DataFrame, root: str = "C:") -> ResolvedTree:
    """Full paths of all files; files under a broken branch are dropped.

    A branch is broken by a missing or non-directory parent, a reparse point, or
    a cycle.  ``directories`` holds ``id, suffix, status, stop`` per directory.
    """
    root = root.rstrip("\\/")
    records, n_rows = _records(nodes)
    directories = _follow(_directory_state(records, n_rows), "node_dirs").select("id", "suffix", "status", "stop")
    files = records.where(~is_directory(F.col("attributes")))
    table = directories.where(F.col("status") == "ok").select(F.col("id").alias("parent_id"), "suffix")
    joined = lookup_join(files, table, "parent_id", "left", F.col("id"), n_rows=n_rows)
    branch = F.when(is_root_reference(F.col("parent_id")), F.lit("")).otherwise(F.col("suffix"))
    entries = joined.withColumn("_branch", branch).where(F.col("_branch").isNotNull()).select(
        "id",
        "parent_id",
        F.concat(F.lit(root), F.col("_branch"), F.lit("\\"), F.col("name")).alias("path"),
        "name",
        "attributes",
    )
    return ResolvedTree(entries, directories)


def resolve_all(nodes: DataFrame, root: str = "C:") -> DataFrame:
    """Full paths of files and directories, sorted by path.

    Here any record may be a parent, reparse points are followed, and only a
    self-parent or the name ``.`` marks the root, which is not listed itself.
    """
    root = root.rstrip("\\/")
    records, n_rows = _records(nodes)
    is_root = (F.col("id") == F.col("parent_id")) | (F.col("name") == ".")
    known = records.select(F.col("id").alias("parent_id"), F.lit(True).alias("_known"))
    linked = lookup_join(records, known, "parent_id", "left", F.col("id"), n_rows=n_rows)
    status = F.when(is_root, F.lit("ok")).when(F.col("_known").isNull(), F.lit("orphan"))
    suffix = F.when(is_root, F.lit("")).otherwise(F.concat(F.lit("\\"), F.col("name")))
    state = linked.select("id", F.col("parent_id").alias("up"), suffix.alias("suffix"), status.alias("status"))
    placed = _follow(state, "node_all").where(F.col("status") == "ok").select("id", "suffix")
    return (
        records.where(~is_root)
        .join(placed, "id")
        .select("id", "parent_id", F.concat(F.lit(root), F.col("suffix")).alias("path"), "name", "attributes")
        .orderBy("path")
    )


def affected_files(nodes: DataFrame, changed: DataFrame, n_files: int | None = None) -> DataFrame:
    """Ids of files that changed or have a changed directory above them.

    ``nodes`` holds each id once; ``changed`` holds ``id, is_dir`` once per id;
    ``n_files`` is a known bound on the rows of ``nodes``.  Only nodes that are
    somebody's parent are followed.
    """
    dirs = changed.where("is_dir").select(F.col("id").alias("up"), F.lit(True).alias("_hit"))
    parents = nodes.select(F.col("parent_id").alias("id")).distinct()
    inner = nodes.join(parents, "id", "left_semi").where(F.col("id") != F.col("parent_id"))
    edges = inner.select("id", F.col("parent_id").alias("up"))
    roots = parents.join(inner.select("id"), "id", "left_anti").select("id", F.lit(None).cast("bigint").alias("up"))
    own = edges.unionByName(roots).join(
        dirs.withColumnRenamed("up", "id"), "id", "left"
    ).select("id", "up", F.coalesce("_hit", F.lit(False)).alias("hit"))
    still = F.col("up").isNotNull() & ~F.col("hit")
    counts = {"open": F.count_if(still), "hits": F.count_if("hit"), "n": F.count(F.lit(1))}
    state, seen = materialize_counting(own, "affected_dirs", **counts)
    before = None
    while seen["open"] and seen != before:
        before = seen
        above = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("hit").alias("_hit"))
        moved = lookup_join(state.where(still), above, "up", "left", F.col("id"), n_rows=seen["open"]).select(
            "id", F.col("_up").alias("up"), F.coalesce("_hit", F.lit(False)).alias("hit")
        )
        state, seen = materialize_counting(state.where(~still).unionByName(moved), "affected_dirs", **counts)
    files = nodes.where(~is_directory(F.col("attributes"))).select("id", "parent_id")
    hits = state.where("hit").select(F.col("id").alias("parent_id"))
    under = lookup_join(files, hits, "parent_id", spread=F.col("id"), n_rows=n_files)
    direct = files.join(changed.select("id"), "id", "left_semi")
    return under.select("id").unionByName(direct.select("id")).distinct()


def diagnostics(nodes: DataFrame, tree: ResolvedTree) -> DataFrame:
    """One row: ``orphan, cyclic, duplicate, reparse`` counts.

    Every file whose own parent is missing or no directory is an orphan.  A
    directory that breaks a branch is counted once, however many files stand
    below it, and not at all when none does; a cycle is counted once.
    """
    duplicates = nodes.agg((F.count(F.lit(1)) - F.count_distinct("id")).alias("duplicate"))
    files = latest_records(nodes).where(
        ~is_directory(F.col("attributes")) & ~is_root_reference(F.col("parent_id"))
    )
    above = tree.directories.select(F.col("id").alias("parent_id"), "status", "stop")
    lost = lookup_join(files.select("id", "parent_id"), above, "parent_id", "left", spread=F.col("id"))
    per_stop = lost.groupBy(F.coalesce("status", F.lit("parentless")).alias("status"), "stop").count()
    counts = per_stop.agg(
        (
            F.coalesce(F.sum(F.when(F.col("status") == "parentless", F.col("count"))), F.lit(0))
            + F.count_if(F.col("status") == "orphan")
        ).alias("orphan"),
        F.count_if(F.col("status") == "cyclic").alias("cyclic"),
        F.count_if(F.col("status") == "reparse").alias("reparse"),
    )
    # Two one-row aggregates side by side.
    return counts.withColumn("_one", F.lit(1)).join(duplicates.withColumn("_one", F.lit(1)), "_one").select(
        "orphan", "cyclic", "duplicate", "reparse"
    )
