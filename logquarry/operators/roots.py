"""Roots and exclusions: which configured directory holds a path.

A short list becomes a Column and costs no shuffle.  A table of any size is
searched by prefix length: a path is probed by hash at the middle of the depths
at which roots exist, then deeper after a hit and shallower after a miss.  So
that a hit tells that deeper roots may follow, the table holds a marker at every
depth on the way to a root, each with the most specific root that holds it.
Eight depths take four equi joins, without a shuffle where the table was counted
and found small; no path is repeated for its ancestors and no prefix condition
compares every path with every root.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.constants import PLATFORM_SKIPPED
from logquarry.functions.paths import ancestor_keys, comparable, depth, file_name, within
from logquarry.plans.skew import checked_broadcast, lookup_join
from logquarry.session import materialize

# Lists up to this length are compiled into an expression.
INLINE_ROOTS = 64

Roots = Sequence[str] | DataFrame


def distinct_paths(df: DataFrame, path: str, order: str) -> DataFrame:
    """Trim, drop blanks and keep the first spelling of each path key."""
    trimmed = df.select(F.trim(F.col(path)).alias(path), F.col(order)).where(F.col(path) != "")
    first = trimmed.groupBy(comparable(F.col(path)).alias("key")).agg(
        F.min_by(path, order).alias(path), F.min(order).alias(order)
    )
    return first.select(path, order)


def _named(roots: DataFrame) -> DataFrame:
    """``(_key, root)`` of the roots that are not blank, one spelling each."""
    named = roots.where(F.trim("root") != "").select("root", comparable(F.col("root")).alias("_key"))
    return named.groupBy("_key").agg(F.min("root").alias("root"))


def _prefix(key: Column, count: Column) -> Column:
    """The first ``count`` components of a comparable path; all of a shorter one."""
    anchor = F.regexp_extract(key, r"^([a-z]:)?/", 0)
    parts = F.call_function("substring_index", key, F.lit("/"), count + (anchor != "").cast("int"))
    return F.when((anchor != "") & (count == 0), anchor).otherwise(parts)


def _level(key: Column) -> Column:
    """The number of components of a comparable path behind its slash or drive."""
    return depth(F.regexp_replace(key, "^([a-z]:)?/", ""))


def _depths(named: DataFrame) -> list[int]:
    """The depths at which roots exist: as many as the longest root has components at most."""
    return sorted(row[0] for row in named.select(_level(F.col("_key"))).distinct().collect())


def root_matches(df: DataFrame, path: str, roots: DataFrame) -> DataFrame:
    """``(path, root, depth)`` for every root containing a path, by equi join at the depths of roots."""
    named = _named(roots)
    prefixes = F.array_distinct(F.array(*[_prefix(F.col("_own"), F.lit(d)) for d in _depths(named)]))
    keyed = df.select(path, comparable(F.col(path)).alias("_own")).select(path, F.explode(prefixes.cast("array<string>")).alias("_key"))
    return lookup_join(keyed, named, "_key", spread=F.col(path)).select(
        path, "root", depth(F.col("root")).alias("_depth")
    )


def _way(depths: Sequence[int], target: int) -> list[int]:
    """The depths above ``target`` that a binary search probes before it."""
    low, high, way = 0, len(depths), []
    while low < high:
        middle = (low + high) // 2
        if depths[middle] == target:
            return way
        if depths[middle] < target:
            way.append(depths[middle])
            low = middle + 1
        else:
            high = middle
    raise ValueError(target)


def _markers(named: DataFrame, depths: Sequence[int]) -> DataFrame:
    """``(_key, _best)``: every root and the markers on the way to it, with the most specific root that holds each."""
    own = F.array(F.struct(F.col("_key").alias("key")))
    ways = F.lit(None).cast("array<struct<key:string>>")
    for d in depths:
        above = F.array(*[F.struct(_prefix(F.col("_key"), F.lit(m)).alias("key")) for m in _way(depths, d)])
        ways = F.when(_level(F.col("_key")) == d, above.cast("array<struct<key:string>>")).otherwise(ways)
    keys = named.select(F.explode(F.concat(own, ways)).alias("k")).select(F.col("k.key").alias("_marker")).distinct()
    holders = F.array_distinct(F.array(*[_prefix(F.col("_marker"), F.lit(d)) for d in depths]))
    met = keys.select("_marker", F.explode(holders).alias("_key")).join(named, "_key")
    return met.groupBy(F.col("_marker").alias("_key")).agg(F.max_by("root", F.length("_key")).alias("_best")).unionByName(
        keys.select(F.col("_marker").alias("_key"), F.lit(None).cast("string").alias("_best"))
    ).groupBy("_key").agg(F.max("_best").alias("_best"))


def _searched(df: DataFrame, path: str, roots: DataFrame) -> DataFrame:
    """``df`` with ``root``, by a binary search over the depths at which roots exist."""
    named = _named(roots)
    depths = _depths(named)
    if not depths:
        return df.withColumn("root", F.lit(None).cast("string"))
    table = materialize(_markers(named, depths), "root_markers").withColumn("_hit", F.lit(True))
    small = checked_broadcast(table)
    table = table if small is None else small
    steps = F.array(*map(F.lit, depths))
    rows = df.withColumns({
        "_own": comparable(F.col(path)), "_low": F.lit(0), "_high": F.lit(len(depths)), "_root": F.lit(None).cast("string"),
    })
    for _ in range(len(depths).bit_length()):
        middle = F.floor((F.col("_low") + F.col("_high")) / 2).cast("int")
        searching = F.col("_low") < F.col("_high")
        # A search that has ended finds its path's own key at most, which changes nothing.
        probe = F.when(searching, _prefix(F.col("_own"), F.get(steps, middle))).otherwise(F.col("_own"))
        met = rows.withColumn("_middle", middle).withColumn("_key", probe).join(table, "_key", "left")
        hit = F.coalesce(F.col("_hit"), F.lit(False))
        rows = met.withColumns({
            "_low": F.when(searching & hit, F.col("_middle") + 1).otherwise(F.col("_low")),
            "_high": F.when(searching & ~hit, F.col("_middle")).otherwise(F.col("_high")),
            "_root": F.coalesce("_best", "_root"),
        }).drop("_key", "_middle", "_best", "_hit")
    return rows.withColumn("root", F.col("_root")).drop("_own", "_low", "_high", "_root").select(*_columns(df, "root"))


def _columns(df: DataFrame, added: str) -> list[Column]:
    """The columns of ``df``, with ``added`` in its place or last."""
    names = df.columns if added in df.columns else [*df.columns, added]
    return [F.col(f"`{name.replace('`', '``')}`") for name in names]


def _inline(path: Column, roots: Sequence[str]) -> Column:
    """The most specific of a few roots, tested deepest first; of two spellings of one, the smaller.

    The key is bound once by a one-element array, so it is computed once per row
    however many roots there are.
    """
    named = {root for root in roots if root.strip()}
    if not named:
        return F.lit(None).cast("string")
    deepest = sorted(named, key=lambda r: (-len([p for p in r.replace("\\", "/").split("/") if p]), r))

    def first_match(key: Column) -> Column:
        return F.coalesce(*[F.when(within(key, comparable(F.lit(r))), F.lit(r)) for r in deepest])

    return F.element_at(F.transform(F.array(comparable(path)), first_match), 1)


def _as_list(df: DataFrame, roots: Roots) -> list[str] | None:
    """The roots when they are few, else None; a table is read only that far.

    A stream takes a list of any length as an expression, since it cannot be
    aggregated and joined with itself; both forms choose the same root.
    """
    if df.isStreaming and not isinstance(roots, DataFrame):
        return list(roots)
    if isinstance(roots, DataFrame):
        few = roots.select("root").limit(INLINE_ROOTS + 1).collect()
        return [row[0] for row in few] if len(few) <= INLINE_ROOTS else None
    return list(roots) if len(roots) <= INLINE_ROOTS else None


def _as_table(df: DataFrame, roots: Roots) -> DataFrame:
    """The roots as a table ``root``."""
    if isinstance(roots, DataFrame):
        return roots
    return df.sparkSession.createDataFrame([(r,) for r in roots], "root string")


def with_root(df: DataFrame, roots: Roots, path: str = "path") -> DataFrame:
    """Add ``root``: the most specific root holding the path, null for none."""
    few = _as_list(df, roots)
    if few is not None:
        return df.withColumn("root", _inline(F.col(path), few))
    return _searched(df, path, _as_table(df, roots))


def refreshed_rows(known: DataFrame, rows: DataFrame, root: str, path: str = "path") -> DataFrame:
    """Those of a root's freshly scanned rows that no more specific root of the table ``known`` owns."""
    added = known.sparkSession.createDataFrame([(root,)], "root string")
    every = known.select("root").unionByName(added).distinct()
    return with_root(rows.drop("root"), every, path).where(F.col("root") == root).select(*rows.columns)


def source_label(root: Column) -> Column:
    """Label of a root: its last component."""
    return file_name(root)


def without_excluded(df: DataFrame, exclusions: Roots, path: str = "path") -> DataFrame:
    """Drop rows equal to or below any exclusion."""
    few = _as_list(df, exclusions)
    if few is not None:
        return df.where(_inline(F.col(path), few).isNull())
    held = _searched(df.withColumn("_row", F.struct(*df.columns)), path, _as_table(df, exclusions)).where("root IS NULL")
    return held.select("_row.*")


def without_platform_directories(df: DataFrame, path: str = "path") -> DataFrame:
    """Drop rows inside directories the platform keeps out of scans."""
    return without_excluded(df, PLATFORM_SKIPPED, path)


def is_covered(df: DataFrame, roots: Roots, path: str = "path") -> DataFrame:
    """Add ``covered``: does any root hold the path?"""
    return with_root(df, roots, path).withColumn("covered", F.col("root").isNotNull()).drop("root")


def minimal_roots(roots: DataFrame) -> DataFrame:
    """Drop every root that lies inside another one."""
    keyed = roots.select("root", comparable(F.col("root")).alias("_key")).dropDuplicates(["_key"])
    # The directory above each root; one without a directory above it is held by none.
    levels = _level(F.col("_key"))
    above = keyed.select(F.col("root").alias("_name"), F.when(levels > 0, _prefix(F.col("_key"), levels - 1)).alias("_above"))
    held = _searched(above, "_above", roots.select("root"))
    return held.where(F.col("root").isNull()).select(F.col("_name").alias("root"))


def add_root(roots: DataFrame, new_root: str) -> DataFrame:
    """Roots after adding one: unchanged when covered, else descendants go.

    ``added`` tells whether the new root is now on the list because of this call.
    """
    key = comparable(F.lit(new_root))
    held = F.col("root")
    if not roots.where(within(key, comparable(held))).isEmpty():
        return roots.select("root", F.lit(False).alias("added"))
    kept = roots.where(~within(comparable(held), key)).select("root", F.lit(False).alias("added"))
    fresh = roots.sparkSession.createDataFrame([(new_root, True)], "root string, added boolean")
    return kept.unionByName(fresh)


def without_subtree(df: DataFrame, removed: Roots, path: str = "path") -> DataFrame:
    """Drop removed paths together with everything below them."""
    return without_excluded(df, removed, path)


def ancestors_of(df: DataFrame, path: str = "path") -> DataFrame:
    """Distinct comparable keys of all directories above the given paths."""
    key = comparable(F.col(path))
    above = df.select(key.alias("_own"), F.explode(ancestor_keys(key)).alias("key"))
    return above.where(F.col("key") != F.col("_own")).select("key").distinct()


def directories_with(df: DataFrame, unread: DataFrame, path: str = "path") -> DataFrame:
    """Directories having a descendant among ``unread`` paths."""
    keys = ancestors_of(unread, "path").withColumnRenamed("key", "_key")
    return df.withColumn("_key", comparable(F.col(path))).join(keys, "_key", "left_semi").drop("_key")
