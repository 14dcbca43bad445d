"""Catalog search: predicates, ranking, exact paging, page merge."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.functions.classify import content_type, kind
from logquarry.functions.paths import path_key
from logquarry.functions.text import name_tokens, query_terms, query_tokens, trigrams
from logquarry.session import materialize

# Pages ending below this many rows come from a top-k; deeper ones from ranks.
TOP_K_ROWS = 20_000


def with_search_columns(catalog: DataFrame) -> DataFrame:
    """Catalog plus its derived search column ``tokens``."""
    return catalog.withColumn("tokens", name_tokens(F.col("name")))


def type_filter(filter_name: str | None) -> Column:
    """``log``, ``archive``, or no restriction."""
    if filter_name == "log":
        return F.col("is_log") & ~F.col("is_archive")
    if filter_name == "archive":
        return F.col("is_archive")
    return F.lit(True)


def has_substrings(terms: list[str]) -> Column:
    """Does every term occur in the lower-cased name and path?"""
    text = F.lower(F.concat_ws(" ", "name", "path"))
    return reduce(and_, [F.contains(text, F.lit(term)) for term in terms])


def has_tokens(tokens: list[str], column: Column | None = None) -> Column:
    """Is every query token among the name's tokens?  ``tokens`` are distinct; without any, nothing matches."""
    if not tokens:
        return F.lit(False)
    held = name_tokens(F.col("name")) if column is None else column
    wanted = F.array(*[F.lit(token) for token in tokens]).cast("array<string>")
    return F.size(F.array_intersect(held, wanted)) == len(tokens)


def query_trigrams(terms: list[str]) -> list[str]:
    """Distinct three-character windows of all terms."""
    return sorted({t[i : i + 3] for t in terms for i in range(len(t) - 2)})


def has_trigrams(terms: list[str]) -> Column:
    """Coarse test by three-character windows; exact only with the substring test."""
    return has_substrings(query_trigrams(terms)) if query_trigrams(terms) else F.lit(True)


def trigram_table(catalog: DataFrame) -> DataFrame:
    """``gram, path``: the optional accelerator, written once per catalog version."""
    text = F.lower(F.concat_ws(" ", "name", "path"))
    return catalog.select("path", F.explode(trigrams(text)).alias("gram"))


def trigram_candidates(table: DataFrame, terms: list[str]) -> DataFrame:
    """Paths holding every three-character window of the terms."""
    grams = query_trigrams(terms)
    hits = table.where(F.col("gram").isin(grams)).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return hits.where(F.col("n") == len(grams)).select("path")


def uses_path_search(terms: list[str]) -> bool:
    """Separators, or letters outside ASCII, call for the substring search."""
    return any(ch in term for term in terms for ch in "\\/:") or not all(t.isascii() for t in terms)


def rank(keyword: str) -> Column:
    """0 exact name, 1 prefix, 2 contained, 3 other."""
    name = F.lower(F.col("name"))
    return (
        F.when(name == keyword, 0)
        .when(F.startswith(name, F.lit(keyword)), 1)
        .when(F.contains(name, F.lit(keyword)), 2)
        .otherwise(3)
    )


def token_order(terms: list[str]) -> list[Column]:
    """Rank by the whole keyword, then lower name, lower path, and the path itself, so the order is total."""
    return [rank(" ".join(terms)), F.lower("name"), F.lower("path"), F.col("path")]


def path_order() -> list[Column]:
    """Shorter names first, then name, then path."""
    return [F.length("name"), F.lower("name"), F.lower("path"), F.col("path")]


def trigram_order(terms: list[str]) -> list[Column]:
    """Exact, prefix or other on the first term, then the path order."""
    name = F.lower(F.col("name"))
    first = F.when(name == terms[0], 0).when(F.startswith(name, F.lit(terms[0])), 1).otherwise(2)
    return [first, *path_order()]


def page(
    df: DataFrame, order: list[Column], offset: int = 0, limit: int = 200, most: int | None = None
) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the global order, at most ``most`` of them where it is given.

    The order must be total: then a near and a deep page agree about every row.

    Near pages are a top-k.  A deep page would pull ``offset`` rows into one
    task, so it sorts by range, counts each range and keeps only its own rows.
    """
    limit, offset = min(max(limit, 1), most or limit), max(offset, 0)
    if offset + limit <= TOP_K_ROWS:
        return df.orderBy(*order).offset(offset).limit(limit)
    return ranked(df, order).where(F.col("position").between(offset + 1, offset + limit)).drop("position")


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``position`` in the global order without sorting in one task."""
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.select("*", *[expr.alias(name) for expr, name in zip(order, names)])
    ranged = keyed.repartitionByRange(*names).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "ranked")
    sizes = ranged.groupBy("_range").count()
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shuffle partition, so this single-task window stays tiny.
    starts = sizes.select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*names)
    numbered = ranged.withColumn("_row", F.row_number().over(inside)).join(F.broadcast(starts), "_range")
    return numbered.withColumn("position", F.col("_row") + F.col("_start")).drop(*names, "_range", "_row", "_start")


@dataclass(frozen=True)
class SearchResult:
    """One page and its one-row statistics."""

    items: DataFrame
    stats: DataFrame


def matching(catalog: DataFrame, query: str, filter_name: str | None = None) -> DataFrame:
    """All catalog rows a query finds, unordered."""
    terms = query_terms(query)
    if not terms:
        return catalog.limit(0)
    rows = catalog.where(type_filter(filter_name))
    if uses_path_search(terms):
        return rows.where(has_substrings(terms))
    held = F.col("tokens") if "tokens" in catalog.columns else None
    return rows.where(has_tokens(query_tokens(query), held))


def order_of(query: str) -> list[Column]:
    """Order of the search a query leads to."""
    terms = query_terms(query)
    return path_order() if uses_path_search(terms) else token_order(terms)


def search(
    catalog: DataFrame,
    query: str,
    filter_name: str | None = None,
    offset: int = 0,
    limit: int = 200,
    partial: bool = False,
    most: int | None = None,
    postings=None,
) -> SearchResult:
    """One ranked page, of at most ``most`` rows where it is given, with the exact total.

    With the catalog's stored ``postings`` only the shortest list of the query is read.
    """
    listed = postings.matching(query, filter_name, catalog) if postings is not None else None
    found = matching(catalog, query, filter_name) if listed is None else listed
    items = page(found, order_of(query), offset, limit, most) if query_terms(query) else found
    items = items.withColumn("kind", kind(F.col("is_log"), F.col("is_archive")))
    stats = found.agg(F.count(F.lit(1)).alias("total")).withColumn("partial", F.lit(partial))
    return SearchResult(items, stats)


def page_details(items: DataFrame, listing: DataFrame) -> DataFrame:
    """Fill size, mtime and readability for the rows of one page only.

    The page's paths pick rows of the listing by an ordinary join: Spark sends
    them to the listing where they are few.
    """
    plain = items.drop("size", "modified_ms")
    facts = listing.select("path", F.col("size").alias("_size"), F.col("modified_ms").alias("_ms"))
    seen = facts.join(plain.select("path"), "path", "left_semi")
    return plain.join(seen, "path", "left").select(
        *plain.columns,
        F.coalesce("_size", F.lit(0)).alias("size"),
        F.col("_ms").alias("modified_ms"),
        F.col("_size").isNotNull().alias("readable"),
        content_type(F.col("name")).alias("content_type"),
    )


def merge_pages(current: DataFrame, incoming: DataFrame, order: str, cap: int | None = None) -> DataFrame:
    """Append a page, keep the first of each path key, keep the first ``cap`` rows where it is given.

    ``order`` is a column both sides hold; rows of ``current`` come first.
    """
    both = current.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    kept = first_by_key(both, F.struct("_side", order)).orderBy("_side", order)
    return (kept if cap is None else kept.limit(cap)).drop("_side")


def first_by_key(df: DataFrame, order: Column, path: str = "path") -> DataFrame:
    """Keep the first row of each path key, combined before the shuffle."""
    packed = df.groupBy(path_key(F.col(path)).alias("_key")).agg(
        F.min_by(F.struct(*df.columns), order).alias("_row")
    )
    return packed.select("_row.*")
