"""Repeated passages across documents by content-defined chunking with a gear rolling hash.

The gear hash of the last ``GEAR_BYTES`` bytes decides at the end of every word whether a chunk ends
there: where the hash is in the lowest quarter, and where it is the least of its neighbourhood, so
that text whose hashes are never low, such as a short loop of words, is cut too.  A cut depends on
the words around it and on nothing else.  So two copies of a passage are cut alike but for its first
and last few words, whatever stands around them and whatever was put in before them.

The digest of a chunk takes in the words behind it up to ``min_words`` words.  The smallest document
that holds a digest therefore holds at least ``min_words`` words of the passage in one piece: no other
document needs to be compared.  Until then only numbers travel.  Then the texts of a document and of
its holders are compared around the places they share, as far as they are equal on both sides.

Digests of one document stop at a bitmap before they are shuffled for the join; a digest that very many
documents hold is one row on one side of that join, and its rows are split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from logquarry.llm.common import fresh, materialize, packed, passing, quoted, rows_of, ship_package, text_or_empty, unpacked

GEAR_BYTES = 16
# A chunk ends at one word in 2 ** CUT_BITS.
CUT_BITS = 2
# Words on either side among which a word with the least hash ends a chunk.
NEIGHBOURS = 6
# Chunks of a batch.
BATCH_CHUNKS = 100_000
#: One number for each byte.
_GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) & 0xFFFF for b in range(256)], np.uint16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the 16-bit gear hash ``h = (h << 1) + gear[byte]`` of the bytes up to it.

    Sixteen shifts push a byte out, so doubling the reach four times gives the rolling value.
    """
    hashes = _GEAR[data]
    reach = 1
    while reach < GEAR_BYTES:
        older = hashes[:-reach] << np.uint16(reach)
        hashes = hashes.copy()
        hashes[reach:] += older
        reach *= 2
    return hashes


def cut_words(hashes: np.ndarray) -> np.ndarray:
    """Which words end a chunk, by the gear hash at the end of each."""
    cut = hashes >> np.uint16(16 - CUT_BITS) == 0
    before = np.concatenate([np.zeros(NEIGHBOURS + 1, np.int64), np.cumsum(cut), np.full(NEIGHBOURS, cut.sum())])
    bare = np.flatnonzero(before[2 * NEIGHBOURS + 1 :] == before[: len(cut)])
    around = np.clip(bare[:, None] + np.arange(-NEIGHBOURS, NEIGHBOURS + 1), 0, max(0, len(cut) - 1))
    cut[bare[hashes[bare] == hashes[around].min(axis=1)]] = True
    cut[-1:] = True
    return cut


def chunks(text: str | None, min_words: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(digest, first word, number of words)`` of the chunks of a text; white space counts as one space.

    A digest takes in ``min_words`` words from the first one on; chunks without so many have none.
    """
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    if len(words) < min_words or not words:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    last = np.flatnonzero(cut_words(gear_hashes(np.frombuffer(whole, np.uint8))[ends - 1]))
    first = np.concatenate([[0], last[:-1] + 1])
    stop = np.maximum(last, first + min_words - 1)
    first, last, stop = (x[stop < len(words)] for x in (first, last, stop))
    begin = np.where(first == 0, 0, ends[first - 1] + 1)
    digests = [xxhash.xxh3_64_intdigest(whole[s:e]) for s, e in zip(begin.tolist(), ends[stop].tolist(), strict=True)]
    return np.array(digests, np.uint64).view(np.int64), first, last - first + 1


def chunk_rows(docs: DataFrame, min_words: int) -> DataFrame:
    """``(digest, doc, first_word)`` of every distinct digest of ``(doc, text)``, at its first place."""
    kind = docs.schema["doc"].dataType

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def batch() -> pa.RecordBatch:
            docs = pa.array([doc for doc, *_ in held], to_arrow_type(kind))
            own = docs.take(pa.array(np.repeat(np.arange(len(held)), [len(x[1]) for x in held])))
            digest, first = (np.concatenate([x[i] for x in held]) for i in (1, 2))
            return pa.RecordBatch.from_arrays([pa.array(digest), own, pa.array(first.astype(np.int32))], ["digest", "doc", "first_word"])

        for doc, text in rows_of(batches, 256):
            digest, first, _ = chunks(text, min_words)
            if len(digest):
                digest, at = np.unique(digest, return_index=True)
                held.append((doc, digest, first[at]))
                count += len(digest)
            if count >= BATCH_CHUNKS:
                yield batch()
                held, count = [], 0
        if held:
            yield batch()

    return docs.mapInArrow(rows, f"digest long, doc {kind.simpleString()}, first_word int")


def _pairs(named: DataFrame, min_words: int) -> DataFrame:
    """``(doc, holder, anchors)``: the places ``(first word in doc, first word in holder)`` of shared digests."""
    rows = materialize(chunk_rows(named, min_words), "chunks")
    # Minima of numbers: a hash aggregation of fixed width.
    holders = rows.groupBy("digest").agg(F.min("doc").alias("holder"), F.max("doc").alias("last"), F.min_by("first_word", "doc").alias("at"))
    holders = materialize(holders.where("holder < last").select("digest", "holder", "at"), "holders")
    later = passing(rows, holders, "digest").join(holders, "digest").where("doc > holder")
    return later.groupBy("doc", "holder").agg(F.collect_set(F.array("first_word", "at")).alias("anchors"))


def equal_spans(own: list, other: list, anchors: list[tuple[int, int]], min_words: int) -> list[tuple[int, int]]:
    """``(first, end)``: the stretches of ``own`` that stand in ``other`` around the anchors ``(first word in own, in other)``."""
    known: dict = {}
    a, b = (np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) for words in (own, other))
    found, shift, edges, base = set(), None, None, 0
    for first, at in sorted(anchors, key=lambda x: (x[1] - x[0], x[0])):
        if shift != at - first:
            shift = at - first
            base, stop = max(0, -shift), min(len(a), len(b) - shift)
            equal = a[base:stop] == b[base + shift : stop + shift] if stop > base else np.empty(0, bool)
            edges = np.concatenate([[-1], np.flatnonzero(~equal), [len(equal)]]) + base
        # The words between two that differ.
        i = int(np.searchsorted(edges, first, "right"))
        if 0 < i < len(edges) and edges[i - 1] < first and edges[i] - edges[i - 1] - 1 >= min_words:
            found.add((int(edges[i - 1]) + 1, int(edges[i])))
    return sorted(found)


def verified_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 30) -> DataFrame:
    """``(<id_col>, first_word, n_words, holder)``: passages that one earlier document holds whole.

    A passage has at least ``min_words`` words, counted from 0 between ASCII white space, and is as long
    as the two texts are equal.  It is found if a chunk begins at least ``min_words`` words before its
    end: passages of more than 50 words are, but for about one in two hundred of those near 50.  The
    holder is a document with a smaller id, the smallest for one of the passage's chunks.  A passage
    inside another one of the document is left out, of equal ones that of the smallest holder stays; the
    first holder of a passage gets no row for it.

    Null and empty texts hold nothing; texts of any length are taken whole.  Rows with a null id are left
    out, since a passage could not be told to be theirs; rows repeated with equal id and text count once,
    and rows of one id with different texts each have their passages, told apart by place alone.  Other
    columns are not read.  An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    named = docs.select(quoted(id_col).alias("doc"), text_or_empty(quoted(text_col)).alias("text")).where("doc IS NOT NULL")
    pairs = materialize(_pairs(named, min_words), "passage_pairs")
    wanted = pairs.select("doc").union(pairs.select("holder")).distinct()
    texts = passing(named, wanted, "doc").select("doc", F.xxhash64("text").alias("body"), packed(F.col("text")).alias("data"))
    texts = materialize(texts.join(wanted, "doc", "left_semi").dropDuplicates(["doc", "body"]), "passage_texts")
    one = texts.select("doc", F.col("data").alias("own"))
    two = texts.select(F.col("doc").alias("holder"), F.col("data").alias("other"))

    @F.pandas_udf("array<array<int>>")
    def spans(own: pd.Series, other: pd.Series, anchors: pd.Series) -> pd.Series:
        out = []
        for a, b, places in zip(own, other, anchors, strict=True):
            words = [unpacked(x).encode("utf-8", "surrogatepass").split() for x in (a, b)]
            out.append(equal_spans(*words, [tuple(p.tolist()) for p in places], min_words))
        return pd.Series(out, dtype=object)

    spanned = pairs.join(one, "doc").join(two, "holder").select("doc", "holder", F.explode(spans("own", "other", "anchors")).alias("s"))
    spanned = spanned.select("doc", "holder", F.col("s")[0].alias("first_word"), F.col("s")[1].alias("end")).distinct()
    # A stretch lies inside one that begins before it, or with it and is longer, and ends no sooner.
    order = Window.partitionBy("doc").orderBy("first_word", F.col("end").desc(), "holder").rowsBetween(Window.unboundedPreceding, -1)
    outer = spanned.withColumn("reached", F.max("end").over(order)).where("reached IS NULL OR end > reached")
    return outer.select(F.col("doc").alias(id_col), "first_word", (F.col("end") - F.col("first_word")).cast("long").alias("n_words"), "holder")


def drop_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 30
) -> DataFrame:
    """``docs`` with the passages of ``verified_passages`` cut out of the texts of their later holders.

    All other columns stay as they are, whatever their names.  The white space behind a passage goes with
    it.  Null texts and rows with a null id stay.  Rows of one id with different texts are cut at the
    places of all of them, as far as they have so many words.  An empty table gives no rows.
    """
    found = verified_passages(docs, id_col, text_col, min_words)
    owner, spans = fresh(docs, "_owner"), fresh(docs, "_spans")
    cuts = found.groupBy(quoted(id_col).alias(owner)).agg(F.collect_list(F.array("first_word", "n_words")).alias(spans))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text: str | None, own: np.ndarray | None) -> str | None:
            if text is None or own is None:
                return text
            # Words and the white space behind each, so that kept words keep theirs.
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            space = (data == 32) | ((data >= 9) & (data <= 13))
            starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(data) else np.empty(0, np.int64)
            edges = np.concatenate([starts, [len(data)]])
            keep = np.ones(len(data), bool)
            for first, many in own:
                keep[edges[min(first, len(starts))] : edges[min(first + many, len(starts))]] = False
            return data[keep].tobytes().decode("utf-8", "surrogatepass")

        return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    joined = docs.join(cuts, quoted(id_col) == quoted(owner), "left")
    return joined.select(*[cut(quoted(c), quoted(spans)).alias(c) if c == text_col else quoted(c) for c in docs.columns])
