"""Benchmark decontamination with spaced seeds.

A seed is a mask over five or fewer neighbouring words that ignores one of them.  The four masks
below find every passage that agrees with a benchmark item in at least four of five words: cut the
item into windows of five words; with at most a fifth of the words replaced, some window has at most
one replaced word, and one of the masks ignores exactly that word.  Hits only propose an alignment;
the words of the whole aligned item are then compared, and those of every stretch of the item on the
alignment and its two neighbours, so that a part of an item counts, and one word put in or left out.

The benchmark is a query set: it is read in blocks of at most ``BLOCK_WORDS`` words, each sent to
all executors, and the documents pass by in a map, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from logquarry.llm.common import fresh, materialize, quoted, rows_of, ship_package, text_or_empty

#: Kept word positions of each mask.
MASKS = ("1111", "10111", "11011", "11101")
WINDOW = 5
# Words of one block of the benchmark: four seeds of 16 bytes each, about 128 MB.
BLOCK_WORDS = 2_000_000
# Words of documents that are compared at once.
SCAN_WORDS = 500_000
# Words of a part of an item that counts by itself.
OVERLAP_WORDS = 13
_KEEP = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def codes_of(text: str | None) -> np.ndarray:
    """One number for each run of letters and digits, in lower case."""
    words = text.lower().encode("utf-8", "replace").translate(_KEEP).split() if text else []
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def seeds_of(codes: np.ndarray, mask: int) -> np.ndarray:
    """The hash of the kept words at every place of the mask."""
    kept = [i for i, c in enumerate(MASKS[mask]) if c == "1"]
    places = len(codes) - len(MASKS[mask]) + 1
    if places <= 0:
        return np.empty(0, np.uint64)
    total = np.full(places, mask + 1, np.uint64)
    for factor, offset in zip(_ODD, kept, strict=True):
        word = codes[offset : offset + places]
        total += ((word ^ (word << np.uint64(17))) + np.uint64(1)) * factor
    return (total ^ (total >> np.uint64(32))) * _ODD[0]


def whole_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` words from every place on."""
    places = max(0, len(codes) - size + 1)
    total = np.full(places, size, np.uint64)
    for i in range(size):
        total = (total ^ (total >> np.uint64(29))) * _ODD[0] + codes[i : i + places]
    return (total ^ (total >> np.uint64(32))) * _ODD[1]


@dataclass(frozen=True)
class Block:
    """Seeds of some benchmark items, sorted by hash, and the items' words."""

    ids: list
    starts: np.ndarray
    sizes: np.ndarray
    codes: np.ndarray
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    filled: np.ndarray
    #: For each length below a window: hashes of the items of so many words, sorted, and the items.
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple[object, str | None]]) -> Block:
        """A block of ``(item_id, text)``; items below five words have no seeds and are kept whole."""
        every = [(key, codes_of(text)) for key, text in rows]
        found = [(key, codes) for key, codes in every if len(codes) >= WINDOW]
        below = [(key, codes) for key, codes in every if 0 < len(codes) < WINDOW]
        short = {}
        for size in {len(codes) for _, codes in below}:
            own = np.array([len(found) + i for i, (_, codes) in enumerate(below) if len(codes) == size])
            hashes = np.concatenate([whole_hashes(below[i - len(found)][1], size) for i in own])
            by = np.argsort(hashes, kind="stable")
            short[size] = hashes[by], own[by]
        sizes = np.array([len(codes) for _, codes in found], np.int64)
        parts = [(i, seeds_of(codes, m)) for i, (_, codes) in enumerate(found) for m in range(len(MASKS))]
        hashes = np.concatenate([s for _, s in parts] or [np.empty(0, np.uint64)])
        item = np.concatenate([np.full(len(s), i) for i, s in parts] or [np.empty(0, np.int64)])
        place = np.concatenate([np.arange(len(s)) for _, s in parts] or [np.empty(0, np.int64)])
        order = np.argsort(hashes, kind="stable")
        bits = max(16, int(len(hashes)).bit_length() + 3)
        filled = np.zeros(1 << bits, bool)
        filled[hashes >> np.uint64(64 - bits)] = True
        codes = np.concatenate([codes for _, codes in found] or [np.empty(0, np.uint64)])
        return cls(
            [key for key, _ in [*found, *below]], np.cumsum(sizes) - sizes, sizes, codes,
            hashes[order], item[order], place[order], filled, short,
        )

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(place in codes, start of the item in codes, item)`` of every hit of a seed."""
        shift = np.uint64(65 - len(self.filled).bit_length())
        places, starts, items = ([np.empty(0, np.int64)] for _ in range(3))
        for mask in range(len(MASKS)):
            seeds = seeds_of(codes, mask)
            at = np.flatnonzero(self.filled[seeds >> shift])
            low = np.searchsorted(self.hashes, seeds[at], "left")
            many = np.searchsorted(self.hashes, seeds[at], "right") - low
            each = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            places.append(np.repeat(at, many))
            starts.append(places[-1] - self.place[each])
            items.append(self.item[each])
        return np.concatenate(places), np.concatenate(starts), np.concatenate(items)

    def whole(self, codes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """``(document, item, first word, words)`` of the first place of each item below a window in each document."""
        for size, (hashes, items) in self.short.items():
            own = whole_hashes(codes, size)
            low = np.searchsorted(hashes, own, "left")
            at = np.flatnonzero(np.searchsorted(hashes, own, "right") > low)
            doc = np.searchsorted(bounds, at, "right") - 1
            inside = at + size <= bounds[doc + 1]
            # The first place of each hash in each document, then every item of that hash.
            pairs, first = np.unique(np.stack([doc[inside], low[at[inside]]]), axis=1, return_index=True)
            for d, i, place in zip(*pairs.tolist(), at[inside][first].tolist(), strict=True):
                for k in range(i, int(np.searchsorted(hashes, hashes[i], "right"))):
                    yield d, int(items[k]), place - int(bounds[d]), size

    def alignments(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(start in codes, item)`` of the distinct alignments that seeds propose."""
        both = np.unique(np.stack(self.hits(codes)[1:]), axis=1)
        return both[0], both[1]

    def compare(self, codes: np.ndarray, bounds: np.ndarray, share: float, hits: tuple | None = None) -> Iterator[tuple[int, int, int, int]]:
        """``(document, item, first word, equal words)`` of the best alignment of each pair that reaches ``share``.

        ``codes`` holds documents end to end, cut at ``bounds``.
        """
        starts, items = np.unique(np.stack((hits or self.hits(codes))[1:]), axis=1)
        # The document that holds the middle of the item; the words outside it do not count.
        middle = np.clip(starts + self.sizes[items] // 2, 0, max(0, len(codes) - 1))
        doc = np.searchsorted(bounds, middle, "right") - 1
        best: dict[tuple[int, int], tuple[int, int]] = {}
        step = max(1, SCAN_WORDS // max(1, int(self.sizes.max(initial=1))))
        for at in range(0, len(starts), step):
            item, start, own = items[at : at + step], starts[at : at + step], doc[at : at + step]
            sizes = self.sizes[item]
            edges = np.cumsum(sizes) - sizes
            within = np.arange(sizes.sum()) - np.repeat(edges, sizes)
            where = np.repeat(start, sizes) + within
            inside = (where >= np.repeat(bounds[own], sizes)) & (where < np.repeat(bounds[own + 1], sizes))
            equal = inside & (codes[np.where(inside, where, 0)] == self.codes[np.repeat(self.starts[item], sizes) + within])
            score = np.add.reduceat(equal.astype(np.int64), edges)
            for i in np.flatnonzero(score >= share * sizes):
                pair = (int(own[i]), int(item[i]))
                found = (int(score[i]), -int(start[i] - bounds[own[i]]))
                best[pair] = max(best.get(pair, found), found)
        for (document, item), (score, start) in best.items():
            yield document, item, -start, score


    def parts(
        self, codes: np.ndarray, bounds: np.ndarray, share: float, words: int, hits: tuple
    ) -> Iterator[tuple[int, int, int, int, int]]:
        """``(document, item, first word, words, equal words)`` of the best part of each pair, as ``benchmark_overlaps`` defines it."""
        places, starts, items = hits
        # Unlike a whole item, a part belongs to the document of its seed.
        owners = np.searchsorted(bounds, places, "right") - 1
        starts, items, owners = np.unique(np.stack([starts, items, owners]), axis=1)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        step = max(1, SCAN_WORDS // max(1, int(self.sizes.max(initial=1))))
        for at in range(0, len(starts), step):
            item, start, own = items[at : at + step], starts[at : at + step], owners[at : at + step]
            sizes = self.sizes[item]
            edges = np.cumsum(sizes) - sizes
            within = np.arange(sizes.sum()) - np.repeat(edges, sizes)
            wanted = self.codes[np.repeat(self.starts[item], sizes) + within]
            low, high = np.repeat(bounds[own], sizes), np.repeat(bounds[own + 1], sizes)
            equal = []
            for shift in (-1, 0, 1):
                where = np.repeat(start, sizes) + within + shift
                inside = (where >= low) & (where < high)
                equal.append(inside & (codes[np.where(inside, where, 0)] == wanted))
            # Windows that could count even with the best of the three alignments for each word.
            sums = np.concatenate([[0], np.cumsum(equal[0] | equal[1] | equal[2])])
            window = np.minimum(words, sizes)
            ends = np.arange(len(within)) + np.repeat(window, sizes)
            fits = within + np.repeat(window, sizes) <= np.repeat(sizes, sizes)
            enough = sums[np.where(fits, ends, 0)] - sums[:-1] >= np.repeat(share * window - 1e-9, sizes)
            for i in np.flatnonzero(np.logical_or.reduceat(fits & enough, edges) if len(edges) else edges):
                span = slice(edges[i], edges[i] + sizes[i])
                found = _best_part([e[span] for e in equal], int(window[i]), share)
                if found:
                    score, first, many, shift = found
                    pair = (int(own[i]), int(item[i]))
                    part = (score, -int(start[i] + shift + first - bounds[own[i]]), -many)
                    best[pair] = max(best.get(pair, part), part)
        for (document, item), (score, first, many) in best.items():
            yield document, item, -first, -many, score


def _best_part(equal: list[np.ndarray], window: int, share: float) -> tuple[int, int, int, int] | None:
    """``(equal words, first word, words, alignment)`` of the best stretch of an item.

    ``equal`` tells which words agree on the alignments -1, 0 and 1; a stretch changes at most once,
    between 0 and a neighbour.  Every window of a stretch reaches the share.
    """
    found = None
    for a, b in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)):
        one, two = (np.concatenate([[0], np.cumsum(equal[s + 1])]) for s in (a, b))
        # A document that lacks a word uses up the item's word at the change.
        skip = int(b < a)
        gain = one[: len(one) - skip] - two[skip:]
        most = np.lib.stride_tricks.sliding_window_view(gain, window + 1 - skip).max(axis=1)
        passing = np.flatnonzero(two[window:] - one[: len(one) - window] + most >= share * window - 1e-9)
        for run in np.split(passing, np.flatnonzero(np.diff(passing) > 1) + 1) if len(passing) else []:
            low, high = int(run[0]), int(run[-1]) + window
            change = low + int(np.argmax(gain[low : high + 1 - skip]))
            path = np.concatenate([equal[a + 1][low:change], np.zeros(skip, bool), equal[b + 1][change + skip : high]])
            ones = np.flatnonzero(path)
            first = low + int(ones[0])
            part = (len(ones), -first, -int(ones[-1] - ones[0] + 1), a if first < change else b)
            found = part if found is None else max(found, part)
    return found and (found[0], -found[1], -found[2], found[3])


def _scan(docs: DataFrame, block: Block, share: float, overlap_words: int | None, short_items: bool, kinds: list[DataType]) -> DataFrame:
    """The overlaps of ``(doc, text)`` with one block of the benchmark."""
    sent = docs.sparkSession.sparkContext.broadcast(block)
    schema = f"doc {kinds[0].simpleString()}, item {kinds[1].simpleString()}, start_word long, n_words long, n_equal long"

    def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        types = [*map(to_arrow_type, kinds), *[pa.int64()] * 3]
        kept: list[tuple[object, np.ndarray]] = []
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            bounds = np.concatenate([[0], np.cumsum([len(c) for _, c in kept])]).astype(np.int64)
            codes = np.concatenate([c for _, c in kept])
            hits = block.hits(codes)
            whole = {(d, i): (start, int(block.sizes[i]), score) for d, i, start, score in block.compare(codes, bounds, share, hits)}
            if overlap_words:
                for d, i, *part in block.parts(codes, bounds, share, overlap_words, hits):
                    whole.setdefault((d, i), part)
            if short_items:
                whole |= {(d, i): (place, size, size) for d, i, place, size in block.whole(codes, bounds)}
            found = [(kept[d][0], block.ids[i], *place) for (d, i), place in whole.items()]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, t) for column, t in zip(zip(*found, strict=True), types, strict=True)],
                    ["doc", "item", "start_word", "n_words", "n_equal"],
                )

        for key, text in rows_of(batches, 256):
            codes = codes_of(text)
            if len(codes) >= (1 if short_items else WINDOW - 1):
                kept.append((key, codes))
                waiting += len(codes)
            if waiting >= SCAN_WORDS:
                yield from flush()
                kept, waiting = [], 0
        if kept:
            yield from flush()

    return docs.mapInArrow(overlaps, schema)


def benchmark_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    share: float = 0.8,
    block_words: int = BLOCK_WORDS,
    overlap_words: int | None = None,
    short_items: bool = True,
) -> DataFrame:
    """``(<id_col>, <item_col>, start_word, n_words, n_equal)``: passages of benchmark items in documents.

    A passage is a place where at least ``share`` (0.8 or more) of the item's words stand in the
    document in the same order, the others being replaced or cut off by the document's ends; words
    are runs of letters and digits, without case.  One row, the best and then earliest place, for
    each document and item.

    With ``overlap_words`` a document and item without such a place get a row for a part of the item:
    a stretch in which, of any ``overlap_words`` neighbouring words of the item (of all words of a
    shorter one), at least ``share`` stand in the document in the same order and at the same distances,
    but for at most one word put in or left out.  ``n_words`` then counts the stretch alone and
    ``start_word`` is its first word.  Of 13 words two may be replaced, or one beside the word put in or
    left out; an item of five or six words with a change in its middle leaves no seed and is not found.

    Items below five words have no seeds: they are looked up whole, by a hash of all their words, and only
    where ``short_items`` says so.  Items without a word are never found; null and empty documents hold nothing; rows with null ids take part.  Repeated documents each get their
    rows, repeated items too.  Other columns are not read.  Empty tables give no rows.
    """
    if share < 0.8:
        raise ValueError("the seeds find passages that agree in at least 0.8 of their words")
    spark = docs.sparkSession
    ship_package(spark)
    kinds = [docs.schema[id_col].dataType, benchmark.schema[item_col].dataType]
    texts = docs.select(F.col(id_col).alias("doc"), text_or_empty(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text IS NOT NULL")
    # A word has at least two bytes with the space behind it.
    total = items.select((F.sum(F.octet_length("text") + 1) / 2).alias("words")).first().words or 0
    blocks = int(total // block_words) + 1
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    found = None
    for number in range(blocks):
        block = Block.of([(r.item, r.text) for r in numbered.where(F.col("block") == number).collect()])
        part = _scan(texts, block, share, overlap_words, short_items, kinds)
        part = materialize(part, "overlaps") if blocks > 1 else part
        found = part if found is None else found.unionByName(part)
    return found.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "start_word", "n_words", "n_equal")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item or a part of one; all columns are kept as they are.

    Rows that share an id are one document; rows with a null id are judged by whether any such row holds a passage.
    Items below five words drop nothing, since clean text holds them too, unless ``short_items`` is given.
    """
    found = benchmark_overlaps(docs, benchmark, id_col, text_col, **{"overlap_words": OVERLAP_WORDS, "short_items": False} | options)
    own = fresh(docs, "_leaked_id")
    leaked = found.select(F.col(id_col).alias(own)).distinct()
    return docs.join(leaked, quoted(id_col).eqNullSafe(quoted(own)), "left_anti")
