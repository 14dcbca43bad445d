"""What a user calls: one function per question.

Every function takes and returns DataFrames, so answers can be joined, filtered
and written like any other table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.constants import DEFAULT_SUFFIXES, ArchiveLimits
from logquarry.functions.classify import archive_format_by_name, arrival_kind
from logquarry.functions.paths import file_name
from logquarry.operators import lines as line_ops
from logquarry.operators import search as search_ops
from logquarry.operators.changes import revision, upsert
from logquarry.operators.roots import Roots, is_covered, refreshed_rows, without_excluded
from logquarry.operators.search import SearchResult, with_search_columns
from logquarry.sources import archives, files, lineindex, textlines
from logquarry.sources.postings import Postings
from logquarry.sources.snapshots import Snapshots

CATALOG_SCHEMA = (
    "path string, name string, root string, size bigint, modified_ms bigint, "
    "is_log boolean, is_archive boolean, tokens array<string>"
)


def open_catalog(spark: SparkSession, path: str) -> Snapshots:
    """The versioned catalog table kept below ``path``, stored by root."""
    return Snapshots(spark, path, spark.createDataFrame([], CATALOG_SCHEMA).schema, ["root"])


def build_catalog(store: Snapshots, roots: Sequence[str], exclusions: Roots = ()) -> int:
    """Scan the roots into a new version and switch to it."""
    rows = files.scan(store.spark, roots, exclusions)
    return store.replace(with_search_columns(rows), "build")


def refresh_root(store: Snapshots, root: str, exclusions: Roots = ()) -> int:
    """Scan one root again; a new version holds its rows of now and the other roots' rows as they were.

    Files below another root inside this one stay with that root.
    """
    fresh = refreshed_rows(store.read().select("root"), files.scan(store.spark, [root], exclusions), root)
    return store.replace_where(F.col("root") == root, with_search_columns(fresh), "refresh")


def merge_catalog(store: Snapshots, rows: DataFrame) -> int:
    """Replace or add catalog rows by path in a new version."""
    return store.replace(upsert(store.read(), with_search_columns(rows.drop("tokens"))), "merge")


def clear_catalog(store: Snapshots) -> int:
    """Empty the catalog."""
    return store.clear()


def catalog_status(catalog: DataFrame) -> DataFrame:
    """Files, logs, archives and bytes of each root."""
    return catalog.groupBy("root").agg(
        F.count(F.lit(1)).alias("indexed_files"),
        F.count_if("is_log").alias("logs"),
        F.count_if("is_archive").alias("archives"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
    )


def search(
    catalog: DataFrame, query: str, filter_name: str | None = None, offset: int = 0, limit: int = 200, partial: bool = False,
    postings: Postings | None = None,
) -> SearchResult:
    """One ranked page of files and the exact total, through the stored posting lists where they are given."""
    return search_ops.search(catalog, query, filter_name, offset, limit, partial, postings=postings)


def build_postings(store: Snapshots, path: str) -> Postings:
    """The posting lists of the live catalog, stored below ``path``."""
    lists = Postings(store.spark, path, store.schema)
    lists.build(store.read(), store.version() or 0)
    return lists


def update_postings(store: Snapshots, lists: Postings, since: int) -> None:
    """Add what changed in the catalog since version ``since`` to its posting lists, as a delta."""
    old, new = store.read(since), store.read()
    same = [F.col(f"_o.{c}").eqNullSafe(F.col(f"_n.{c}")) for c in store.schema.names]
    both = old.select("path", F.struct(*old.columns).alias("_o")).join(new.select("path", F.struct(*new.columns).alias("_n")), "path", "full")
    both = both.where(F.col("_o").isNull() | F.col("_n").isNull() | ~reduce(and_, same))
    lists.add(both.where("_n IS NOT NULL").select("_n.*"), both.where("_n IS NULL").select("path"), store.version() or 0)


def inventory(catalog: DataFrame, directory: str) -> DataFrame:
    """Content of one directory in display order."""
    return files.inventory(catalog, directory).orderBy(*files.inventory_order())


def entries(spark: SparkSession, paths, nested: bool = True, limits: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """Entries of containers, and of containers within them."""
    found = archives.read_containers(spark, paths)
    return archives.all_entries(found, limits) if nested else archives.entries(archives.start_level(found), limits)


def entry_lines(
    spark: SparkSession, paths, limits: ArchiveLimits = ArchiveLimits(), entry: str | None = None
) -> DataFrame:
    """Lines of the log entries of containers, of containers within them, and of compressed files.

    ``entry`` asks for one alone, its containers before it: ``inner.zip::logs/a.log``.
    """
    found = archives.read_containers(spark, paths)
    return archives.lines_of_entry(found, entry.split("::"), limits) if entry else archives.nested_lines(found, limits)


def lines(spark: SparkSession, paths, charset: str | None = None, splittable: bool = True) -> DataFrame:
    """Numbered lines of text files of any size: ``path, line_no, raw_len, content, truncated``.

    Either way each file gets a charset of its own when none is given.  UTF-16 needs
    ``splittable=False``: its lines are found by an index, which is made first.
    """
    if splittable:
        return textlines.read_lines(spark, paths, charset)
    return lineindex.indexed_lines(lineindex.index_lines(spark, paths, charset=charset))


def index_lines(spark: SparkSession, paths, folder: str | None = None, charset: str | None = None) -> DataFrame:
    """The stored line index of text files, for :func:`indexed_range`."""
    return lineindex.index_lines(spark, paths, folder, charset=charset)


def indexed_range(index: DataFrame, start: int, count: int, path: str | None = None) -> DataFrame:
    """Lines ``start + 1`` to ``start + count`` in order, of one indexed file or of each; only their bytes are read."""
    return lineindex.indexed_range(index, start, count, path).orderBy("path", "line_no")


def read_lines(table: DataFrame, start: int, count: int) -> DataFrame:
    """Lines ``start + 1`` to ``start + count`` in order."""
    return line_ops.read_range(table, start, count).orderBy("line_no")


def line_counts(table: DataFrame, key: str = "path") -> DataFrame:
    """Lines per file."""
    return line_ops.line_counts(table, key)


def export_lines(table: DataFrame, published: int, path: str) -> DataFrame:
    """Copy the first lines of each file byte for byte; tells how many bytes and whether all."""
    return line_ops.export_lines(table, published, path)


def classify(spark: SparkSession, paths) -> DataFrame:
    """``path, kind, format``: archive by leading bytes, else text, else null."""
    content = archives.with_format(archives.read_containers(spark, paths))
    name = file_name(F.col("path"))
    return content.select("path", arrival_kind(F.col("head"), name, F.col("format")).alias("kind"), "format")


def covered(paths: DataFrame, roots: Roots) -> DataFrame:
    """Is each path inside a root?"""
    return is_covered(paths, roots)


def revisions(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``path, revision`` of existing files."""
    listed = files.listing(spark, paths)
    return listed.select("path", revision(F.col("size"), F.col("modified")).alias("revision"))


def watched(catalog: DataFrame, suffixes: Sequence[str] = tuple(DEFAULT_SUFFIXES), exclusions: Roots = ()) -> DataFrame:
    """Catalog rows passing the suffix filter and outside the exclusions."""
    from logquarry.functions.classify import passes_filter

    archive = archive_format_by_name(F.col("name")).isNotNull()
    return without_excluded(catalog, exclusions).where(passes_filter(F.col("name"), archive, suffixes))
