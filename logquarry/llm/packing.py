"""Best-fit packing of documents into training sequences, with a vector of capacities.

Every sequence has room for so many tokens, documents and attention cost (the sum of squared piece
lengths).  Documents are tokenised in a map and cut into pieces; pieces are dealt into groups of
about ``GROUP_ITEMS`` documents, sorted from long to short, and stream through the group's task,
which keeps only what its open sequences have left.  A piece goes to the open sequence that it fits
under every capacity and that the rule prefers: the smallest weighted norm of what stays free, or
the largest weighted dot product of the piece with what is free.  A full piece is a sequence of its own.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from logquarry.llm.common import rows_of, ship_package, text_or_empty

GROUP_ITEMS = 8_192
# Tokens of a batch of pieces.
BATCH_TOKENS = 1_000_000
#: White space as Unicode defines it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pattern that splits text before the merges of byte-level BPE, but for its rule on runs of white space.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
# That rule: the last character of a run stays with the word behind it.
_RUNS = re.compile(f"(?<=[{_SPACE}])(?=[{_SPACE}][^{_SPACE}])")


@cache
def encoder(path: str) -> Callable[[str], list[int]]:
    """The ids of a text under a tokenizer file; the file's added tokens, such as an end mark, are found in texts.

    A byte-level BPE whose ids rise in the order of its merges, as is usual, is run by ``tiktoken``
    on the file's own vocabulary, which gives the ids of ``tokenizers`` several times faster; any
    other file is run by ``tokenizers`` itself.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    ranks = _ranks(spec)
    if ranks is None:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        return lambda text: whole.encode(text, add_special_tokens=False).ids
    import tiktoken

    merges = tiktoken.Encoding(path, pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})

    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    # Of two added tokens at one place the longer one is found.
    marks = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def ordinary(text: str) -> list[int]:
        parts = _RUNS.split(text)
        if len(parts) == 1:
            return merges.encode_ordinary(text)
        return [token for part in parts for token in merges.encode_ordinary(part)]

    def encode(text: str) -> list[int]:
        parts = marks.split(text) if marks else [text]
        if len(parts) == 1:
            return ordinary(text)
        # Every second part is an added token.
        return [token for i, part in enumerate(parts) for token in ([added[part]] if i % 2 else ordinary(part))]

    return encode


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Token bytes and ids of a byte-level BPE file, or None for any other kind of file."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer")
    added = spec.get("added_tokens", [])
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or not plain:
        return None
    if any(t.get(rule) for t in added for rule in ("single_word", "lstrip", "rstrip")) or not all(t["content"] for t in added):
        return None
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [model["vocab"]["".join(pair)] for pair in pairs]
    if made != sorted(made):
        return None
    # The printable characters that stand for bytes: themselves, and from 256 on for all others.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    marks = {t["content"] for t in added}
    return {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in marks}


def pieces(
    docs: DataFrame, path: str, piece_tokens: int, end_id: int, groups: int, id_type: DataType
) -> DataFrame:
    """``(doc, piece, start, length, ids, part)`` of ``(doc, text)``; ids take two bytes each where they can."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        names = ["doc", "piece", "start", "length", "ids"]
        kinds = [to_arrow_type(id_type), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        rows: list[tuple] = []
        held = 0
        for doc, text in rows_of(batches, 256):
            ids = np.array([*encode(text), end_id], "<u4")
            narrow = ids.astype("<u2") if ids.max() < 65536 else ids
            start, number = 0, 0
            size = len(ids) % piece_tokens or piece_tokens
            while start < len(ids):
                rows.append((doc, number, start, size, narrow[start : start + size].tobytes()))
                start, number, size = start + size, number + 1, piece_tokens
            held += len(ids)
            if held >= BATCH_TOKENS:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kind = id_type.simpleString()
    out = docs.mapInArrow(cut, f"doc {kind}, piece int, start long, length long, ids binary")
    return out.withColumn("part", F.pmod(F.xxhash64("doc", "piece", "ids"), F.lit(groups)))


class OpenSequences:
    """What open sequences have left of each capacity, and the choice among them."""

    def __init__(self, capacities: tuple[int, ...], weights: tuple[float, ...], rule: str) -> None:
        self.capacities = np.array(capacities, np.float64)
        scale = np.sqrt(np.array(weights)) / self.capacities
        self.scale, self.dot = scale, rule == "dot"
        self.free = np.empty((len(capacities), 256))
        self.numbers = np.empty(256, np.int64)
        self.used = np.empty(256, np.int64)
        self.open = self.total = 0

    def place(self, tokens: int) -> tuple[int, int]:
        """``(sequence number, offset)`` for a piece of so many tokens."""
        need = np.array([tokens, 1, tokens * tokens], np.float64)
        free = self.free[:, : self.open]
        left = free - need[:, None]
        fits = np.flatnonzero((left >= 0).all(axis=0))
        if len(fits):
            if self.dot:
                at = fits[np.argmax((need * self.scale**2) @ free[:, fits])]
            else:
                at = fits[np.argmin(((left[:, fits] * self.scale[:, None]) ** 2).sum(axis=0))]
        else:
            at = self.open
            if at == len(self.numbers):
                self.free = np.concatenate([self.free, np.empty_like(self.free)], axis=1)
                self.numbers, self.used = (np.concatenate([x, np.empty_like(x)]) for x in (self.numbers, self.used))
            self.free[:, at], self.numbers[at], self.used[at] = self.capacities, self.total, 0
            self.open, self.total = self.open + 1, self.total + 1
        found = int(self.numbers[at]), int(self.used[at])
        self.free[:, at] -= need
        self.used[at] += tokens
        if self.free[:, at].min() < 1:  # full: no piece fits any more
            self.open -= 1
            self.free[:, at], self.numbers[at], self.used[at] = self.free[:, self.open], self.numbers[self.open], self.used[self.open]
        return found


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 2,
    max_docs: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001),
    rule: str = "norm",
    group_items: int = GROUP_ITEMS,
) -> DataFrame:
    """``(<id_col>, piece, start, length, ids, sequence_id, offset)``: where each piece of each document goes.

    ``tokenizer`` is a tokenizer file that every executor can open.  A document is its ids and then
    ``end_id``; one longer than a sequence is cut, its first piece being the shorter one.  ``ids`` are
    the piece's token ids, little-endian, four bytes each.  ``max_docs`` and ``max_attention`` (sum of
    squared piece lengths) bound a sequence besides ``capacity``; pieces are never longer than either
    allows.  Null and empty texts are documents of the end id alone; rows with null ids are packed too;
    repeated rows are packed each.  Other columns are not read.  An empty table gives no rows.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    ship_package(docs.sparkSession)
    most_docs, most_cost = max_docs or capacity, max_attention or capacity**2
    piece_tokens = min(capacity, math.isqrt(most_cost))
    texts = docs.select(F.col(id_col).alias("doc"), text_or_empty(text_col).alias("text"))
    groups = max(1, -(-docs.count() // group_items))
    id_type = docs.schema[id_col].dataType
    cut = pieces(texts, tokenizer, piece_tokens, end_id, groups, id_type)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sequences = None, None
        for batch in batches:
            size = batch.column(batch.schema.get_field_index("length")).to_pylist()
            parts = batch.column(batch.schema.get_field_index("part")).to_pylist()
            data = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            ids, numbers, offsets = [], [], []
            for part, length, raw in zip(parts, size, data, strict=True):
                if part != current:
                    current, sequences = part, OpenSequences((capacity, most_docs, most_cost), weights, rule)
                number, offset = sequences.place(length)
                ids.append(np.frombuffer(raw, "<u2").astype("<u4").tobytes() if len(raw) == 2 * length else raw)
                numbers.append(part * 2**32 + number)
                offsets.append(offset)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc", "piece", "start", "length")]
            columns += [pa.array(ids, pa.binary()), pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "piece", "start", "length", "ids", "sequence_id", "offset"])

    kind = id_type.simpleString()
    schema = f"doc {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long"
    order = ["part", F.col("length").desc(), "doc", "piece", "ids"]
    packed = cut.repartition("part").sortWithinPartitions(*order).mapInArrow(fit, schema)
    return packed.withColumnRenamed("doc", id_col)
