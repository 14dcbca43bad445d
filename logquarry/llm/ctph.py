"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last eight bytes ends a chunk wherever its low ``k`` bits are all set, so chunks
are about ``2 ** k`` bytes and depend on nearby bytes only.  Each chunk gives one character of a
signature.  A fingerprint takes the smallest ``k`` that leaves at most ``MOST`` chunks and holds the
signatures for ``k``, ``k + 1`` and ``k + 2``; two fingerprints are compared by edit distance at the
smallest block size that both have.
"""

from __future__ import annotations

import hashlib
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from logquarry.llm.common import materialize, quoted, rows_of, ship_package, text_or_empty

MOST = 64
SIZES = 3
SMALLEST = 0
# Characters in a row that two signatures must share; half of the shorter one where that is less.
SHARED = 4
# Bytes hashed at once: bounds memory for very long texts.
BLOCK_BYTES = 1 << 22
_REACH = 8
_ALPHABET = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"
_BYTE = np.array([zlib.crc32(bytes([b, 77])) for b in range(256)], np.uint32)
_BASE = 0x01000193


def rolling_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte a polynomial hash of the last eight, built by doubling the reach three times."""
    hashes, reach = _BYTE[data], 1
    while reach < _REACH:
        older = hashes[:-reach] * np.uint32(pow(_BASE, reach, 1 << 32))
        hashes = hashes.copy()
        hashes[reach:] += older
        reach *= 2
    return hashes


def _ends(data: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``(place, level)`` of the bytes whose hash has at least ``bits`` low bits set; the level counts them."""
    places, levels = [], []
    mask = np.uint32((1 << bits) - 1)
    for at in range(0, len(data), BLOCK_BYTES):
        before = min(at, _REACH - 1)
        hashes = rolling_hashes(data[at - before : at + BLOCK_BYTES])[before:]
        here = np.flatnonzero((hashes & mask) == mask)
        lowest = ~hashes[here] & (hashes[here] + np.uint32(1))  # the lowest bit that is not set
        levels.append(np.where(lowest == 0, 32, np.log2(np.maximum(lowest, 1))).astype(np.int64))
        places.append(here + at)
    return np.concatenate(places), np.concatenate(levels)


def fingerprint(text: str | None) -> str:
    """``k:signature:signature:signature`` for block sizes ``2 ** k`` and the next two; equal texts give equal ones."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    if not raw:
        return f"{SMALLEST}:::"
    data = np.frombuffer(raw, np.uint8)
    bits = max(SMALLEST, (len(raw) // MOST).bit_length() - 3)
    places, levels = _ends(data, bits)
    while len(places) < MOST and bits > SMALLEST:
        bits -= 1
        places, levels = _ends(data, bits)
    while (levels >= bits).sum() >= MOST:
        bits += 1
    found = []
    for level in range(bits, bits + SIZES):
        edges = [0, *(places[levels >= level] + 1).tolist()]
        if edges[-1] != len(raw):
            edges.append(len(raw))
        found.append("".join(_ALPHABET[zlib.crc32(raw[s:e]) & 63] for s, e in zip(edges, edges[1:], strict=False)))
    return ":".join([str(bits), *found])


def _common(a: str, b: str) -> int:
    """The length of the longest common subsequence, with one machine word for each row."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        match = row & where.get(c, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def likeness(a: str, b: str) -> float:
    """From 0 to 1: 1 less the edit distance (characters put in or left out) over both signatures' lengths.

    Fingerprints without a common block size, or whose signatures share no run of ``SHARED`` characters,
    are not alike at all; equal ones are wholly alike.
    """
    if a == b:
        return 1.0
    (low, *first), (high, *second) = a.split(":"), b.split(":")
    shift = int(high) - int(low)
    if shift < 0:
        first, second, shift = second, first, -shift
    if shift >= SIZES:
        return 0.0
    x, y = first[shift], second[0]
    if not x or not y:
        return 0.0
    run = min(SHARED, max(1, min(len(x), len(y)) // 2))
    runs = {x[i : i + run] for i in range(len(x) - run + 1)}
    if not any(y[i : i + run] in runs for i in range(len(y) - run + 1)):
        return 0.0
    return 2 * _common(x, y) / (len(x) + len(y))


def fingerprint_column(text: Column) -> Column:
    """The fingerprint of a text; a null counts as empty."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(fingerprint)

    return of(F.coalesce(text, F.lit("")))


def likeness_column(a: Column, b: Column) -> Column:
    """The likeness of two fingerprints."""

    @F.pandas_udf("double")
    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y) for x, y in zip(left, right, strict=True)], dtype="float64")

    return of(a, b)


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of the whole text in ``out_col``, whose place it takes where there is one."""
    ship_package(docs.sparkSession)
    return docs.withColumn(out_col, fingerprint_column(quoted(text_col)))


def edited(text: str, following: str) -> str:
    """The text with its last half, rounded down, replaced by as many first characters of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _report(texts: tuple[str, str], prints: tuple[str, str]) -> tuple[int, str, str, str, float, float]:
    new = edited(*texts)
    new_print = fingerprint(new)
    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return len(texts[0]), digest, prints[0], new_print, likeness(prints[0], new_print), likeness(*prints)


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How fingerprints react to replacing the last half of each text by the next document's beginning.

    ``(<id_col>, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``,
    one row per row of ``docs``.  The next document is that of the next smaller id, and the first
    after the last; null ids are the smallest, and rows of one id are ordered by a hash of their text.
    A null text counts as empty.  Other columns are not read.  An empty table gives no rows.

    Texts are range-partitioned once; each task walks its sorted rows.  The last row of a partition
    needs the first of the next one: these two rows of every partition are set aside and go through
    the same walk in fewer partitions, until one is left.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    names = ["doc", "tie", "text", "first", "last", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    arrow = [to_arrow_type(kind), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    schema = (
        f"doc {kind.simpleString()}, tie long, text string, first boolean, last boolean, n_chars long, "
        "edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )

    def walk(inner: bool, close: bool):
        """``inner``: rows are the edges of partitions, of which only a last one and its follower are neighbours."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            start = before = None

            def edge(row: tuple, first: bool, last: bool) -> tuple:
                return (*row[:3], first, last, *[None] * 6)

            for doc, tie, text, first, last in rows_of(batches, 256):
                row = (doc, tie, text, fingerprint(text), first, last)
                if before is None:
                    start = row
                elif not inner or before[5]:
                    out.append((*before[:2], None, None, None, *_report((before[2], text), (before[3], row[3]))))
                before = row
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), arrow, strict=True)], names)
                    out = []
            if before is not None and close:
                out.append((*before[:2], None, None, None, *_report((before[2], start[2]), (before[3], start[3]))))
            elif before is not None and start is before:
                out.append(edge(before, True, True))
            elif before is not None:
                out += [edge(start, True, False), edge(before, False, True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), arrow, strict=True)], names)

        return run

    order = [F.col("doc").desc_nulls_last(), F.col("tie").desc()]
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"))
    rows = rows.select("*", F.lit(False).alias("first"), F.lit(False).alias("last"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    inner, done = False, None
    while True:
        dealt = rows.repartitionByRange(parts, *order) if parts > 1 else rows.repartition(1)
        walked = materialize(dealt.sortWithinPartitions(*order).mapInArrow(walk(inner, parts == 1), schema), "walked")
        found = walked.where("text IS NULL").drop("tie", "text", "first", "last")
        done = found if done is None else done.unionByName(found)
        if parts == 1:
            break
        rows, inner = walked.where("text IS NOT NULL").select("doc", "tie", "text", "first", "last"), True
        parts = parts // 64 + 1 if parts > 64 else 1
    return done.withColumnRenamed("doc", id_col)
