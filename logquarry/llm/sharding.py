"""Shards of bounded size by extendible hashing, with DataFrame operations only.

A row's path is a string of bits: the first 60 of its key's MD5, then 64 of its own.  A bucket is a
prefix of paths; one that holds more than the limit, and more than one row, is split on the next bit.
Sums over all prefixes of some depths say at once which buckets split, so there is one round for
many bits; only rows of buckets that are still too large at the last of these depths go into the next
round.  The directory of a round has an entry for each prefix of its last depth.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import materialize, materialize_counting, text_or_empty

KEY_BITS = 60
ROW_BITS = 64
# Bits of the first round beyond those that shards of even size would need, and of each later round.
SPARE_BITS = 4
MORE_BITS = 8


def key_path(key: Column) -> Column:
    """The first 60 bits of the MD5 of a key as text, as a string of 0 and 1; a null key counts as empty."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, KEY_BITS // 4)
    return F.lpad(F.conv(digits, 16, 2), KEY_BITS, "0")


def _round(rows: DataFrame, done: int, depth: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Shards of the buckets of ``done`` bits, split on bits up to ``depth``; and the prefixes still too large.

    ``rows`` are ``(path, bytes)`` of buckets that split.  Shards are ``(shard, shard_bytes, shard_rows)``.
    """
    cells = rows.groupBy(F.substring("path", 1, depth).alias("cell")).agg(
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")
    )
    cells = cells.withColumn("depth", F.explode(F.sequence(F.lit(done), F.lit(depth))))
    buckets = cells.groupBy(F.expr("substring(cell, 1, depth)").alias("shard"), "depth").agg(
        F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows")
    )
    buckets = materialize(buckets.withColumn("split", (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)), "buckets")
    parents = buckets.where("split").select(F.col("shard").alias("parent"))
    whole = ~F.col("split") & (F.col("depth") > done)
    below = buckets.where(whole).withColumn("parent", F.expr("substring(shard, 1, depth - 1)"))
    shards = below.join(parents, "parent").select("shard", "depth", "shard_bytes", "shard_rows")
    if done == 0:
        shards = shards.unionByName(buckets.where("depth = 0 AND NOT split").select(shards.columns))
    large = buckets.where(F.col("split") & (F.col("depth") == depth)).select(F.col("shard").alias("cell"))
    return shards, large


def _directory(shards: DataFrame, depth: int) -> DataFrame:
    """An entry ``cell`` of ``depth`` bits for each prefix below a shard."""
    wide = shards.withColumn("entry", F.explode(F.expr(f"sequence(0L, shiftleft(1L, {depth} - depth) - 1)")))
    suffix = F.expr(f"if(depth < {depth}, lpad(bin(entry), {depth} - depth, '0'), '')")
    return wide.select(F.concat("shard", suffix).alias("cell"), "shard", "shard_bytes", "shard_rows")


def extendible_shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = 1 << 20
) -> DataFrame:
    """``(<id_col>, bytes, shard, shard_bytes, shard_rows)``, one row per row of ``docs``.

    ``bytes`` is the size of the text in UTF-8, 0 for null; ``shard`` is the prefix of hash bits that
    the shard's rows share, empty where all rows fit in one.  A shard holds at most ``max_bytes``,
    unless it is a single row that is larger.  Rows of one key stay together while they fit; a key
    (or null) with more than ``max_bytes`` is split on bits of its rows, so a hot key is many shards.
    Other columns are not read.  An empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.octet_length(text_or_empty(text_col)).cast("long").alias("bytes"),
        F.lpad(F.conv(F.hex(F.xxhash64(F.monotonically_increasing_id())), 16, 2), ROW_BITS, "0").alias("own"),
    )
    rows = rows.select("id", "bytes", F.concat(key_path(F.col("id")), "own").alias("path"))
    rows, seen = materialize_counting(rows, "paths", total=F.sum("bytes"))
    done, depth = 0, SPARE_BITS + max(0, math.ceil(math.log2(max(1, (seen["total"] or 0) / max_bytes))))
    out = None
    while True:
        shards, large = _round(rows.select("path", "bytes"), done, depth, max_bytes)
        directory = _directory(shards, depth)
        held = rows.withColumn("cell", F.substring("path", 1, depth))
        placed = held.join(directory, "cell").select("id", "bytes", "shard", "shard_bytes", "shard_rows")
        out = placed if out is None else out.unionByName(placed)
        if depth == KEY_BITS + ROW_BITS or large.isEmpty():
            break
        rows = materialize(held.join(large, "cell", "left_semi").drop("cell"), "split_paths")
        done, depth = depth, min(KEY_BITS + ROW_BITS, depth + MORE_BITS)
    return out.withColumnRenamed("id", id_col)
