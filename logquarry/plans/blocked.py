"""Running values over long groups, computed block by block.

A window partitioned by a file puts the whole file into one task.  Here a file
is cut into blocks of bounded size; a window runs inside each block, one partial
aggregate per block gives the block totals, and a running sum over those few
totals supplies what each block starts from.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1_000_000


def id_block(order: str, rows: int = BLOCK_ROWS) -> Column:
    """Block of a unique integer column: never more than ``rows`` rows each."""
    return F.floor(F.col(order) / rows)


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    block: Column,
    position: str | None = None,
    sums: Mapping[str, Column] | None = None,
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add running columns per ``keys`` in ``order``.

    ``position`` names a 1-based row number; ``sums`` maps a new column to the
    expression whose values *before* the row are summed; ``previous`` and
    ``following`` map a new column to the column whose value in the row before or
    after is wanted.
    ``block`` must not decrease with ``order`` inside a key.
    """
    sums, previous, following = dict(sums or {}), dict(previous or {}), dict(following or {})
    rows = df.withColumn("_block", block)
    groups = [*keys, "_block"]

    totals = [F.count(F.lit(1)).alias("_n")]
    totals += [F.sum(expr).alias(f"_t_{name}") for name, expr in sums.items()]
    totals += [F.max_by(F.struct(col), F.col(order)).alias(f"_l_{name}") for name, col in previous.items()]
    totals += [F.min_by(F.struct(col), F.col(order)).alias(f"_f_{name}") for name, col in following.items()]
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy(*keys).orderBy("_block")
    bases = rows.groupBy(*groups).agg(*totals).select(
        *groups,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b_n"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums],
        *[F.lag(f"_l_{n}").over(last).alias(f"_p_{n}") for n in previous],
        *[F.lead(f"_f_{n}").over(last).alias(f"_q_{n}") for n in following],
    )

    inside = Window.partitionBy(*groups).orderBy(order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    columns = [F.col(c) for c in df.columns]
    local = [F.row_number().over(inside).cast("bigint").alias("_i")] if position else []
    local += [F.coalesce(F.sum(expr).over(earlier), F.lit(0)).alias(f"_s_{n}") for n, expr in sums.items()]
    local += [F.lag(F.struct(col)).over(inside).alias(f"_v_{n}") for n, col in previous.items()]
    local += [F.lead(F.struct(col)).over(inside).alias(f"_w_{n}") for n, col in following.items()]
    placed = rows.select(*columns, "_block", *local).join(bases, groups)

    out = [(F.col("_i") + F.col("_b_n")).alias(position)] if position else []
    out += [(F.col(f"_s_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums]
    out += [
        F.coalesce(F.col(f"_v_{n}"), F.col(f"_p_{n}")).getField(col).alias(n) for n, col in previous.items()
    ]
    out += [
        F.coalesce(F.col(f"_w_{n}"), F.col(f"_q_{n}")).getField(col).alias(n) for n, col in following.items()
    ]
    return placed.select(*columns, *out)
