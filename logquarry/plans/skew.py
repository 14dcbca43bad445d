"""Joins and sizes that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when it was counted and found this small.
BROADCAST_ROWS = 200_000
# A key is hot when one task would get more rows than this.
HOT_ROWS = 2_000_000
# Hot keys looked at; keys past this stay whole, which is slower but still right.
HOT_KEYS = 1_000
SALTS = 64


def at_most(df: DataFrame, rows: int) -> bool:
    """Does ``df`` hold no more than ``rows`` rows?  Reads at most one more."""
    return df.limit(rows + 1).count() <= rows


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """``df`` hinted for broadcast when its size is proven small, else None."""
    return F.broadcast(df) if at_most(df, rows) else None


def hot_values(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> list:
    """Values of ``key`` with more than ``hot_rows`` rows, most frequent first.

    Counts are combined before the shuffle.  The list only steers salting, so
    bounding it never changes a result.
    """
    counts = df.groupBy(key).count().where((F.col("count") > hot_rows) & F.col(key).isNotNull())
    return [row[0] for row in counts.orderBy(F.desc("count")).limit(HOT_KEYS).collect()]


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "inner",
    spread: Column | None = None,
    hot_rows: int = HOT_ROWS,
    n_rows: int | None = None,
) -> DataFrame:
    """Join many ``rows`` to a ``table`` holding each ``key`` once.

    A table proven small is broadcast.  Otherwise rows of hot keys are spread
    over salts, and only those table rows are repeated, once per salt.
    ``spread`` is what tells rows of one key apart (default: every column).
    When ``n_rows``, the known size of ``rows``, is too small for a hot key,
    the planner decides by the table's own size and nothing is counted.
    """
    if n_rows is not None and n_rows <= hot_rows:
        return rows.join(table, key, how)
    small = checked_broadcast(table)
    if small is not None:
        return rows.join(small, key, how)
    hot = hot_values(rows, key, hot_rows)
    if not hot:
        return rows.join(table, key, how)
    unlike = F.xxhash64(spread) if spread is not None else F.xxhash64(*rows.columns)
    is_hot = F.col(key).isin(hot)
    salted = rows.withColumn("_salt", F.when(is_hot, F.pmod(unlike, F.lit(SALTS))).otherwise(F.lit(0)))
    every = F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")
    only = F.array(F.lit(0)).cast("array<bigint>")
    repeated = table.withColumn("_salt", F.explode(F.when(is_hot, every).otherwise(only)))
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")
