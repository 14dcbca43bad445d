"""Near copies by the Jaccard similarity of their five-word shingles.

Two texts at similarity 0.8 differ in about ten of 64 SimHash bits, so blocks of equal bits are too
short to shard by.  Shards are the bands of MinHash values instead: two texts at similarity ``s``
share one of ``BANDS`` bands of ``BAND_ROWS`` values with probability ``1 - (1 - s**5)**20``, 0.9996
at 0.8.  In each shard a BK-tree over the SimHash fingerprints of the same shingles proposes pairs
within ``RADIUS`` bits, and the exact similarity of every proposed pair is computed on the texts.

Texts with equal shingle sets are one node.  A first round proposes one earlier text for each text of
a shard; a second one proposes all pairs whose texts the first round did not connect.  So a large
family of copies costs rows, not pairs, and no link between two groups is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import ascii_words, connected_components, fresh, materialize, packed, quoted, ship_package, text_or_empty, unpacked
from logquarry.llm.simhash import BITS, BKTree

BANDS = 20
BAND_ROWS = 5
# Similarity 0.8 gives 9.7 bits on average with a deviation of 2.9.
RADIUS = 24
# Shingles whose MinHash values are computed at once: bounds memory for very long texts.
COUNTED = 16_384
_ODD = np.random.default_rng(11).integers(0, 2**63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the word shingles; a shorter text is one shingle."""
    words = ascii_words(text)
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        total = (total ^ (total >> np.uint64(29))) * _MIX + codes[i : i + len(total)]
    total = (total ^ (total >> np.uint64(32))) * _MIX
    return np.unique(total ^ (total >> np.uint64(29)))


def sketch(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """The SimHash fingerprint of a set of shingles, and the key of each band."""
    ones, least = np.zeros(BITS, np.int64), np.full(len(_ODD), 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), COUNTED):
        part = hashes[at : at + COUNTED]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        for i, odd in enumerate(_ODD):
            least[i] = min(least[i], (part * odd).min())
    keys = [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, BAND_ROWS))]
    return int(np.packbits(ones * 2 > len(hashes)).view("<u8")[0]), np.array(keys, np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sets of shingles; two empty ones are equal."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    """``(id, node, fp, keys)`` of every row of ``(id, text)``; ``node`` names the shingle set."""

    @F.pandas_udf("node long, fp long, keys array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        nodes, prints, keys = [], [], []
        for text in texts:
            hashes = shingles(text, size)
            fp, own = sketch(hashes)
            nodes.append(xxhash.xxh3_64_intdigest(hashes.tobytes()))
            prints.append(fp)
            keys.append(own.view(np.int64))
        signed = [np.array(c, np.uint64).view(np.int64) for c in (nodes, prints)]
        return pd.DataFrame({"node": signed[0], "fp": signed[1], "keys": keys})

    return docs.select("id", of("text").alias("s")).select("id", "s.*")


def _proposed(shards: DataFrame, every: bool, radius: int) -> DataFrame:
    """Distinct ``(a, b)`` of nodes in one shard within the radius: one earlier node for each, or all of other roots."""
    ship_package(shards.sparkSession)

    def propose(rows: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
        if every and len({root for _, _, root in rows}) < 2:
            return
        tree, holders = BKTree(), {}
        for node, fp, root in rows:
            fp &= 2**BITS - 1
            # The members met so far at each fingerprint, by root.
            for other in tree.within(fp, radius):
                near = [n for r, nodes in holders[other].items() if r != root for n in nodes]
                if near and not every:
                    yield near[0], node
                    break
                yield from ((n, node) for n in near)
            tree.add(fp)
            own = holders.setdefault(fp, {}).setdefault(root, [])
            if every or not own:
                own.append(node)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list) -> pa.RecordBatch:
            found = list(propose(rows))
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        current, rows = None, []
        for part in batches:
            for band, key, *row in zip(*[column.to_pylist() for column in part.columns], strict=True):
                if (band, key) != current:
                    if len(rows) > 1:
                        yield batch(rows)
                    current, rows = (band, key), []
                rows.append(tuple(row))
        if len(rows) > 1:
            yield batch(rows)

    rows = shards.select("band", "key", "node", "fp", "root")
    rows = rows.repartition("band", "key").sortWithinPartitions("band", "key", "node")
    return rows.mapInArrow(pairs, "a long, b long").distinct()


def _texts(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``(node, data)``: one compressed text of each wanted node."""

    @F.pandas_udf("long")
    def node_of(texts: pd.Series) -> pd.Series:
        nodes = [xxhash.xxh3_64_intdigest(shingles(t, size).tobytes()) for t in texts]
        return pd.Series(np.array(nodes, np.uint64).view(np.int64))

    text = text_or_empty("text")
    every = docs.select(node_of(text).alias("node"), packed(text).alias("data"))
    return every.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def _verified(pairs: DataFrame, texts: DataFrame, least: float, size: int) -> DataFrame:
    """The pairs whose texts reach the similarity; ``texts`` holds ``(node, data)``."""

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        sides = zip(a, b, strict=True)
        return pd.Series([similarity(*[shingles(unpacked(x), size) for x in side]) >= least for side in sides], dtype=bool)

    one = texts.select(F.col("node").alias("a"), F.col("data").alias("data_a"))
    two = texts.select(F.col("node").alias("b"), F.col("data").alias("data_b"))
    return pairs.join(one, "a").join(two, "b").where(similar("data_a", "data_b")).select("a", "b")


def similar_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    least: float = 0.8,
    radius: int = RADIUS,
) -> DataFrame:
    """``(<id_col>, component_id)``, one row per row of ``docs``.

    Rows are linked when the sets of their word shingles have Jaccard similarity ``least`` or more;
    ``component_id`` is the smallest id that links lead to.  Null and wordless texts have the empty
    set and are linked with each other; a text below ``shingle_words`` words is one shingle.  Rows
    with a null id take part.  An empty table gives no rows.  Other columns are not read.
    """
    ship_package(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = materialize(_sketches(named, shingle_words), "sketches")
    nodes = rows.groupBy("node").agg(F.min("id").alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    shards = nodes.select("node", "fp", F.posexplode("keys").alias("band", "key"))
    # Bands that one node holds propose nothing.
    shared = shards.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "key")
    shards = materialize(shards.join(shared, ["band", "key"], "left_semi"), "similar_shards")
    wanted = shards.select("node").distinct()
    texts = materialize(_texts(named, wanted, shingle_words), "similar_texts")
    firsts = _proposed(shards.withColumn("root", F.col("node")), False, radius)
    found = materialize(_verified(firsts, texts, least, shingle_words), "similar_links")
    roots = materialize(connected_components(found), "similar_roots")
    rooted = shards.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = _proposed(rooted, True, radius)
    found = found.unionByName(materialize(_verified(rest, texts, least, shingle_words), "similar_links"))
    roots = connected_components(found)
    rooted = rows.select("id", "node").join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "similar_rooted")
    lowest = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return rooted.join(lowest, "root").select(F.col("id").alias(id_col), "component_id")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each group of near copies.

    Rows that share an id are one document and go or stay together; rows with a null id stay.
    All columns are kept as they are.
    """
    found = similar_components(docs, id_col, text_col, **options)
    own = fresh(docs, "_copy_id")
    copies = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(own)).distinct()
    return docs.join(copies, quoted(id_col) == quoted(own), "left_anti")
