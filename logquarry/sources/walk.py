"""Directory walks in which executors list: a frontier of directories, level by level.

Each level is a table of the directories to list, dealt over the tasks; what they hold is written, and
its directories are the next frontier, but for excluded ones, those a platform keeps out, those of
another device, and links, which are never followed.  The driver lists nothing and holds no names.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.functions.paths import comparable
from logquarry.operators.roots import Roots, without_excluded, without_platform_directories
from logquarry.session import materialize_counting, ship_package

LISTED = "kind string, path string, size bigint, modified timestamp, device bigint, root_device bigint"
#: What an entry of a directory is; ``unreadable`` is a directory that could not be listed.
KINDS = ("file", "dir", "link", "other", "unreadable")
# Entries of a batch of rows.
BATCH_ROWS = 10_000


@dataclass(frozen=True)
class Walk:
    """Files ``path, size, modified``, unreadable directories, and the counters of the walk."""

    files: DataFrame
    unreadable: DataFrame
    counts: dict[str, int]


def list_directory(path: str) -> Iterator[tuple[str, str, int | None, int | None, int | None]]:
    """``(kind, path, size, microseconds of the last change, device)`` of the entries of a directory.

    A directory that cannot be listed gives one row of its own.  Local directories tell links and devices;
    other stores have neither.
    """
    local = re.sub("^file:(//)?(?=/)", "", path)
    try:
        if "://" in local:
            store, inside = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
            scheme = path[: path.index("://") + 3]
            for info in store.get_file_info(fs.FileSelector(inside)):
                kind = "dir" if info.type == fs.FileType.Directory else "file" if info.type == fs.FileType.File else "other"
                changed = None if info.mtime_ns is None else info.mtime_ns // 1000
                yield kind, scheme + info.path, info.size, changed, None
            return
        with os.scandir(local) as found:
            for entry in found:
                name = os.fsencode(entry.path).decode("utf-8", "replace")
                try:
                    facts = entry.stat(follow_symlinks=False)
                except OSError:
                    continue  # gone since it was listed
                kind = "link" if entry.is_symlink() else "dir" if entry.is_dir(follow_symlinks=False) else "file" if entry.is_file(follow_symlinks=False) else "other"
                yield kind, name, facts.st_size, facts.st_mtime_ns // 1000, facts.st_dev
    except OSError:
        yield "unreadable", path, None, None, None


def _listed(frontier: DataFrame) -> DataFrame:
    """The entries of the directories ``path, root_device``; those of a root tell its device."""
    ship_package(frontier.sparkSession)
    kinds = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.int64(), pa.int64()]
    names = [part.split()[0] for part in LISTED.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for part in batches:
            for path, device in zip(part.column("path").to_pylist(), part.column("root_device").to_pylist(), strict=True):
                if device is None and "://" not in path.removeprefix("file://"):
                    try:
                        device = os.stat(re.sub("^file:(//)?(?=/)", "", path)).st_dev
                    except OSError:
                        pass
                for row in list_directory(path):
                    rows.append((*row, device))
                    if len(rows) >= BATCH_ROWS:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    return frontier.mapInArrow(run, LISTED)


def _counted(frontier: DataFrame) -> tuple[DataFrame, int]:
    frontier, seen = materialize_counting(frontier, "frontier", n=F.count(F.lit(1)))
    return frontier, seen["n"]


def walk(spark: SparkSession, roots: Sequence[str], exclusions: Roots = (), skip_platform: bool = False) -> Walk:
    """All files below the roots, hidden ones too, and what was scanned and skipped.

    A root inside another one is listed once, with itself.  Excluded roots and those that are no
    directory hold nothing.  ``counts`` has ``directories`` and ``files`` scanned, and
    ``skipped_directories``, those that could not be listed.
    """
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    start = spark.createDataFrame([(r.rstrip("/") or "/",) for r in dict.fromkeys(roots) if r.strip()], "path string").distinct()
    keys = start.select(comparable(F.col("path")).alias("_key"))
    frontier = without_excluded(start, exclusions).withColumn("root_device", F.lit(None).cast("bigint"))
    levels, counts, first = [], {"directories": 0, "files": 0, "skipped_directories": 0}, True
    while True:
        # Written, so that a level is decided and counted once.
        frontier, listed = _counted(frontier)
        seen = {f"n_{kind}": F.count_if(F.col("kind") == kind) for kind in KINDS}
        rows, seen = materialize_counting(_listed(frontier.repartition(tasks, "path")), "walk", **seen)
        levels.append(rows)
        counts["directories"] += listed - seen["n_unreadable"]
        # A root that is missing is no directory that was skipped.
        counts["skipped_directories"] += 0 if first else seen["n_unreadable"]
        counts["files"] += seen["n_file"]
        first = False
        if not seen["n_dir"]:
            break
        inner = rows.where("kind = 'dir' AND device <=> root_device").select("path", "root_device")
        inner = without_excluded(inner, exclusions)
        if skip_platform:
            inner = without_platform_directories(inner)
        frontier = inner.withColumn("_key", comparable(F.col("path"))).join(F.broadcast(keys), "_key", "left_anti").drop("_key")
    every = reduce(DataFrame.unionByName, levels)
    files = without_excluded(every.where("kind = 'file'").select("path", "size", "modified"), exclusions)
    unreadable = reduce(DataFrame.unionByName, [rows.limit(0) if i == 0 else rows for i, rows in enumerate(levels)])
    return Walk(files, unreadable.where("kind = 'unreadable'").select("path"), counts)
