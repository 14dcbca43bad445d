"""SimHash near-duplicates found with BK-trees over shards of fingerprints.

A fingerprint within Hamming distance ``radius`` of another equals it on at least one of
``radius + 1`` blocks of bits.  Fingerprints with an equal block form a shard; each shard gets a
BK-tree, whose children are keyed by their distance to the parent, and every fingerprint of the
shard follows only the edges within the radius.  The trees grow with the data, so they are not
broadcast whole: a shard's fingerprints and its tree meet in the task that owns the shard.  Shards
above ``max_shard`` fingerprints are split again by blocks of their remaining bits, which keeps the
same guarantee, so no shard is cut and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import ascii_words, connected_components, fresh, materialize, quoted, ship_package

BITS = 64
SEED = 42
# Shingles whose bits are counted at once: bounds memory for very long texts.
COUNTED = 65_536
# Splits of a shard; after three, with radius 3, shards agree on 37 of 64 bits.
LEVELS = 3


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """The 64-bit SimHash of the word shingles, repeats included; 0 for a text without words."""
    words = ascii_words(text)
    if not words:
        return 0
    whole = b" ".join(words)
    size = min(shingle_words, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes) + np.arange(len(words))
    starts = (ends - sizes)[: len(words) - size + 1]
    ends = ends[size - 1 :]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), COUNTED):
        spans = zip(starts[at : at + COUNTED].tolist(), ends[at : at + COUNTED].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(whole[s:e], SEED) for s, e in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts)).view("<u8")[0])


def fingerprint_column(text: Column, shingle_words: int = 3) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        prints = np.fromiter((fingerprint(t, shingle_words) for t in texts), np.uint64, len(texts))
        return pd.Series(prints.view(np.int64))

    return of(text)


class BKTree:
    """A tree of integers whose children are keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        """Insert a value; one that is there already changes nothing."""
        if self.root is None:
            self.root = (value, {})
            return
        at, children = self.root
        while distance := (at ^ value).bit_count():
            below = children.get(distance)
            if below is None:
                children[distance] = (value, {})
                return
            at, children = below

    def within(self, value: int, radius: int) -> Iterator[int]:
        """The values within the radius, following only edges that can lead to one."""
        stack = [self.root] if self.root else []
        while stack:
            at, children = stack.pop()
            distance = (at ^ value).bit_count()
            if distance <= radius:
                yield at
            for edge in range(distance - radius, distance + radius + 1):
                if edge in children:
                    stack.append(children[edge])


def _masks(level: int, parts: int) -> list[int]:
    """The bits on which the shards of a level agree, by path."""
    paths: list[tuple[list[int], int]] = [(list(range(BITS)), 0)]
    for _ in range(level):
        deeper = []
        for free, fixed in paths:
            cuts = [len(free) * i // parts for i in range(parts + 1)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                deeper.append((free[:low] + free[high:], fixed | sum(1 << bit for bit in free[low:high])))
        paths = deeper
    return [fixed - (1 << BITS) if fixed >> (BITS - 1) else fixed for _, fixed in paths]


def _descend(rows: DataFrame, level: int, parts: int) -> DataFrame:
    """One row for each shard of this level below the row's shard."""
    masks = F.array(*[F.lit(mask).cast("long") for mask in _masks(level, parts)])
    child = F.posexplode(F.slice(masks, F.col("path") * parts + 1, parts)).alias("i", "mask")
    below = rows.select("fp", "path", child)
    return below.select("fp", (F.col("path") * parts + F.col("i")).alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def shards(prints: DataFrame, radius: int = 3, max_shard: int = 256) -> DataFrame:
    """``(fp, level, path, key)``: every shard of every distinct fingerprint ``fp``."""
    parts = radius + 1
    rows = _descend(prints.select("fp", F.lit(0).alias("path")), 1, parts)
    done = []
    for level in range(1, LEVELS + 1):
        leveled = rows.withColumn("level", F.lit(level))
        large = rows.groupBy("path", "key").count().where(F.col("count") > max_shard).select("path", "key")
        large = materialize(large, "large_shards") if level < LEVELS else None
        if large is None or large.isEmpty():
            done.append(leveled)
            break
        done.append(leveled.join(large, ["path", "key"], "left_anti").select(leveled.columns))
        rows = _descend(rows.join(large, ["path", "key"], "left_semi"), level + 1, parts)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def links(prints: DataFrame, radius: int = 3, max_shard: int = 256) -> DataFrame:
    """``(a, b)`` of distinct fingerprints within the radius, enough of them to connect every group."""
    ship_package(prints.sparkSession)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tree, parent = None, BKTree(), {}

        def top(node: int) -> int:
            while parent[node] != node:
                parent[node] = node = parent[parent[node]]
            return node

        for batch in batches:
            found: tuple[list[int], list[int]] = ([], [])
            for value, *shard in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                if shard != current:
                    current, tree, parent = shard, BKTree(), {}
                parent[value] = value
                for other in tree.within(value & (2**BITS - 1), radius):
                    other -= (other >> (BITS - 1)) << BITS
                    if top(other) != top(value):
                        parent[top(value)] = top(other)
                        found[0].append(other)
                        found[1].append(value)
                tree.add(value & (2**BITS - 1))
            yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in found], ["a", "b"])

    keys = ["level", "path", "key"]
    rows = shards(prints, radius, max_shard).select("fp", *keys)
    return rows.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(link, "a long, b long")


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 3,
    radius: int = 3,
    max_shard: int = 256,
) -> DataFrame:
    """``(<id_col>, fingerprint, component_id)``, one row per row of ``docs``.

    The fingerprint has 16 hex digits.  Rows are linked when their fingerprints differ in at most
    ``radius`` bits; ``component_id`` is the smallest id that links lead to.  A null or wordless text
    has fingerprint zero and is linked like any other; a text below ``shingle_words`` words is one
    shingle.  A row with a null id takes part and gets its component's smallest id, null if it has
    none.  Repeated rows stay, each with the same result.  An empty table gives no rows.  Other
    columns are not read.
    """
    ship_package(docs.sparkSession)
    prints = materialize(
        docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), shingle_words).alias("fp")), "prints"
    )
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct_prints")
    roots = connected_components(materialize(links(distinct.select("fp"), radius, max_shard), "print_links"))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = materialize(rooted.select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted_prints")
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    members = materialize(rooted.join(lowest, "root").select("fp", "component_id"), "print_components")
    out = prints.join(members, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each group of near copies.

    Rows that share an id are one document and go or stay together; rows with a null id stay.
    All columns are kept as they are.
    """
    found = simhash_components(docs, id_col, text_col, **options)
    own = fresh(docs, "_copy_id")
    copies = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(own)).distinct()
    return docs.join(copies, quoted(id_col) == quoted(own), "left_anti")
