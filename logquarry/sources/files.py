"""Catalog sources: scans of file systems and inventories of directories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from logquarry.functions.classify import is_archive_name, is_log_name
from logquarry.functions.paths import file_name
from logquarry.operators.changes import epoch_millis
from logquarry.operators.roots import Roots, with_root
from logquarry.sources.walk import walk


def plain_path(path):
    """Drop the scheme a file listing puts before a path."""
    return (
        F.when(F.startswith(path, F.lit("file:///")), F.substring(path, 8, 2**31 - 1))
        .when(F.startswith(path, F.lit("file:/")), F.substring(path, 6, 2**31 - 1))
        .otherwise(path)
    )


def listing(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """``path, size, modified`` of every file below the roots.

    Only metadata is selected, so no file is opened.  Names beginning with a dot
    or an underscore are left out by Spark's listing, and links are followed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots))
    return files.select(
        plain_path(F.col("path")).alias("path"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    )


def catalog_rows(files: DataFrame, roots: Roots) -> DataFrame:
    """Catalog rows of listed files: name, size, mtime, class by name, root."""
    named = files.withColumn("name", file_name(F.col("path")))
    return with_root(named, roots).select(
        "path",
        "name",
        "root",
        "size",
        epoch_millis(F.col("modified")).alias("modified_ms"),
        is_log_name(F.col("name")).alias("is_log"),
        is_archive_name(F.col("name")).alias("is_archive"),
    )


def scan(
    spark: SparkSession, roots: Sequence[str], exclusions: Roots = (), skip_platform: bool = False
) -> DataFrame:
    """Catalog rows of everything below the roots except excluded subtrees; links are not followed."""
    return catalog_rows(walk(spark, roots, exclusions, skip_platform).files, list(roots))


def scan_counted(
    spark: SparkSession, roots: Sequence[str], exclusions: Roots = (), skip_platform: bool = False
) -> tuple[DataFrame, dict[str, int]]:
    """:func:`scan` and its counters: ``directories``, ``files`` and ``skipped_directories``."""
    found = walk(spark, roots, exclusions, skip_platform)
    return catalog_rows(found.files, list(roots)), found.counts


def observed(catalog: DataFrame, name: str = "scan") -> tuple[DataFrame, Observation]:
    """Catalog that counts itself while some other action runs over it."""
    seen = Observation(name)
    counted = catalog.observe(
        seen,
        F.count(F.lit(1)).alias("indexed"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.count_if("is_log").alias("logs"),
    )
    return counted, seen


def inventory(catalog: DataFrame, directory: str) -> DataFrame:
    """Files and sub-directories directly inside one directory.

    Archives count as logs here; directories have size 0 and come first.
    """
    base = directory.rstrip("/")
    below = catalog.where(F.startswith(F.col("path"), F.lit(base + "/")))
    rest = F.substr(F.col("path"), F.lit(len(base) + 2))
    slash = F.instr(rest, "/")
    direct = below.where(slash == 0).select(
        "path",
        "name",
        F.when(F.col("is_archive"), F.lit("archive")).otherwise(F.lit("file")).alias("kind"),
        "size",
        (F.col("is_archive") | F.col("is_log")).alias("is_log"),
    )
    child = F.substring_index(rest, "/", 1)
    dirs = below.where(slash > 0).select(
        F.concat(F.lit(base + "/"), child).alias("path"),
        child.alias("name"),
        F.lit("dir").alias("kind"),
        F.lit(0).cast("bigint").alias("size"),
        F.lit(False).alias("is_log"),
    ).distinct()
    return direct.unionByName(dirs)


def inventory_order() -> list:
    """Directories first, then lower-cased name, then path."""
    return [F.col("kind") != "dir", F.lower("name"), F.col("path")]


def status_by_root(events: DataFrame) -> DataFrame:
    """Last known provider state of each root from ``root, provider, phase, reason, seq``."""
    last = F.max_by(F.struct("provider", "phase", "reason"), "seq")
    return events.groupBy("root").agg(last.alias("s")).select("root", "s.*")


def total_bytes(files: DataFrame) -> DataFrame:
    """One row: bytes of all listed files."""
    return files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
