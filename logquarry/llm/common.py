"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry import session
from logquarry.session import materialize, materialize_counting

__all__ = [
    "FILTER_BITS",
    "PIECE_BITS",
    "ascii_words",
    "connected_components",
    "fresh",
    "materialize",
    "materialize_counting",
    "maybe_among",
    "packed",
    "passing",
    "quoted",
    "rows_of",
    "ship_package",
    "text_or_empty",
    "unpacked",
]


# Bits of a filter, in pieces of 4096 bytes: 16 MiB whatever the keys are.
FILTER_BITS = 1 << 27
PIECE_BITS = 8 * 4096


# Bytes of an Arrow batch of texts: the JVM and each Python worker hold a few of them at once.
BATCH_BYTES = 4 << 20


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python tasks, and keep the batches of texts that they get small."""
    session.ship_package(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    value = spark.conf.get(name).removesuffix("b")
    if not value.isdigit() or int(value) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def quoted(name: str) -> Column:
    """The column of this name, whatever characters it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def maybe_among(rows: DataFrame, keys: DataFrame, key: list[str], flag: str) -> DataFrame:
    """``rows`` with ``flag``: false only where ``key`` is none of ``keys``, and for most rows where it is none.

    A bitmap of fixed size is broadcast, so rows without a partner can be told before a shuffle.
    """
    place = F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS))
    piece, bit = F.floor(place / PIECE_BITS), place % PIECE_BITS
    pieces = keys.select(piece.alias("_piece"), bit.alias("_bit")).groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    # At most FILTER_BITS / PIECE_BITS pieces of 4096 bytes.
    met = rows.withColumn("_piece", piece).join(F.broadcast(pieces), "_piece", "left")
    held = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    return met.withColumn(flag, held).drop("_piece", "_bits")


def passing(rows: DataFrame, keys: DataFrame, *key: str) -> DataFrame:
    """Rows whose ``key`` may be one of ``keys``: all those that are, and few others."""
    return maybe_among(rows, keys, list(key), "_held").where("_held").drop("_held")


def packed(text: Column) -> Column:
    """A text as compressed UTF-8; null stays null."""

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        codec = zstandard.ZstdCompressor(level=1)
        return pd.Series([None if t is None else codec.compress(t.encode("utf-8", "surrogatepass")) for t in texts], dtype=object)

    return pack(text)


def unpacked(data: bytes) -> str:
    """The text of ``packed``."""
    return zstandard.ZstdDecompressor().decompress(data).decode("utf-8", "surrogatepass")


def ascii_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def text_or_empty(column: str | Column) -> Column:
    """The text, or an empty one for a null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def rows_of(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, a few at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield from zip(*[column.to_pylist() for column in part.columns], strict=True)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``; the root is a node of the component.

    Every round hangs each node on its smallest neighbour and contracts the graph, so the tables
    shrink from round to round; the rounds' maps are then composed from the last to the first.
    Each round is a written table: nothing is collected, and lost executors cost no earlier round.
    """
    links = edges.select("a", "b").where("a <> b")
    maps: list[DataFrame] = []
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("near"))
        parents, seen = materialize_counting(
            near.select(F.col("a").alias("node"), F.least("a", "near").alias("root")), "parents", n=F.count(F.lit(1))
        )
        if seen["n"] == 0:
            break
        maps.append(parents)
        left = parents.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = parents.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = links.join(left, "a").join(right, "b").where("ra <> rb")
        links = materialize(
            moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links"
        )
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    resolved = maps[-1]
    for earlier in reversed(maps[:-1]):
        later = resolved.select(F.col("node").alias("root"), F.col("root").alias("top"))
        resolved = earlier.join(later, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return resolved
