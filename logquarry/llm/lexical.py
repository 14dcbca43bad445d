"""Ranked lexical search: an inverted index in shards, searched by Block-Max MaxScore.

``build_index`` turns documents into shards in one map, each a row of its own: for every term of the
shard the documents that hold it, in compressed blocks of ``BLOCK`` postings.  The parts of a score
that depend on all documents (their number and length) are not known yet, so a block's header holds
its *edge*: the few pairs of occurrences and document length that no other posting of the block
beats.  The greatest score of a block follows from its edge for any corpus, without unpacking it.

``search_index`` sends a block of queries to the shards.  For every query and shard

* the lists are sorted by their greatest score and read from the greatest on; what they give raises the
  threshold, the query's k-th best score so far; lists that together stay below it are non-essential:
  no document is found by them alone;
* candidates then meet the non-essential lists from the greatest to the least; one that cannot
  reach the threshold even with its block's greatest score is rejected before the block is unpacked.

A task keeps the best ``k`` of each query over all its shards; these heaps are merged in two steps.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from logquarry.llm.common import materialize, rows_of, ship_package, text_or_empty

# Postings of a compressed block.
BLOCK = 128
# A shard ends with the document that reaches either number; places fit into 16 bits.
SHARD_POSTINGS = 400_000
SHARD_DOCS = 32_768
# The index is written in row groups of about so many bytes, compressed, which a task holds whole.  Parquet looks at sizes after 100
# rows only unless it is told otherwise, and 100 shards are half a gigabyte.
GROUP_BYTES = 8 << 20
_CHECKED = {"parquet.page.row.count.limit": 1} | {f"parquet.{part}.size.row.check.{end}": 1 for part in ("block", "page") for end in ("min", "max")}
# Bytes of the texts of the queries sent at once; they and their weights take about ten times as much.
QUERY_BYTES = 8_000_000
# Heaps of one query that are merged at once.
MERGED = 64
SCALE = 1_000_000_000
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_INDEX = "docs long, total long, terms array<binary>, df array<int>, lengths binary, last binary, edges binary, offsets binary, payload binary"


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII, with A-Z in lower case."""
    return text.translate(_KEEP).split()


def norms(lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The length part of the scores: ``75 + 25 * length / mean length``, rounded down, exactly."""
    unique, each = np.unique(lengths, return_inverse=True)
    return np.array([75 + 25 * n * documents // total for n in unique.tolist()], np.int64)[each]


def impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What ``tf`` occurrences give before the term's weight."""
    return SCALE * tf // (1000 * tf + 12 * norm)


def shard_row(counts: list[dict[bytes, int]], lengths: list[int]) -> list:
    """The columns of the index for the documents of a shard, without their ids."""
    codes: dict[bytes, int] = {}
    code = np.fromiter((codes.setdefault(t, len(codes)) for c in counts for t in c), np.int64)
    tf = np.fromiter((n for c in counts for n in c.values()), np.int64, len(code))
    doc = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
    order = np.argsort(code, kind="stable")
    doc, tf, code = doc[order], tf[order], code[order]
    df = np.bincount(code, minlength=len(codes))
    start = np.cumsum(df) - df
    # A block begins at every BLOCK-th posting of a list.
    first = np.flatnonzero((np.arange(len(code)) - start[code]) % BLOCK == 0)
    ends = np.append(first[1:], len(code))
    block = np.repeat(np.arange(len(first)), ends - first)
    sizes = np.array(lengths, np.int64)
    # The edge: by ascending length, every posting with more occurrences than all before it.
    by = np.lexsort((-tf, sizes[doc], block))
    most = np.maximum.accumulate((block[by] << 32) + np.minimum(tf[by], 2**31))
    edge = by[np.concatenate([[True], most[1:] > most[:-1]])]
    pack = zstandard.ZstdCompressor(level=1).compress
    places, often = doc.astype("<u2"), tf.astype("<u4")
    parts = [pack(places[a:b].tobytes() + often[a:b].tobytes()) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
    edges = np.stack([block[edge], tf[edge], sizes[doc[edge]]]).astype("<i8")
    offsets = np.cumsum([0, *map(len, parts)]).astype("<i8")
    return [
        len(counts), int(sizes.sum()), list(codes), df.tolist(), pack(sizes.astype("<i8").tobytes()),
        pack(doc[ends - 1].astype("<u2").tobytes()), pack(edges.tobytes()), pack(offsets.tobytes()), b"".join(parts),
    ]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of ``docs``, a row for each shard, written to the shared folder; documents without terms are left out."""
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    named = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("ids", pa.list_(to_arrow_type(kind)))] + [
            ("docs", pa.int64()), ("total", pa.int64()), ("terms", pa.list_(pa.binary())), ("df", pa.list_(pa.int32())),
            *[(name, pa.binary()) for name in ("lengths", "last", "edges", "offsets", "payload")],
        ])
        ids, counts, lengths, postings = [], [], [], 0

        def batch() -> pa.RecordBatch:
            row = [ids, *shard_row(counts, lengths)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for key, text in rows_of(batches, 256):
            if words := terms_of(text):
                ids.append(key)
                lengths.append(len(words))
                counts.append(Counter(words))
                postings += len(counts[-1])
                if postings >= SHARD_POSTINGS or len(ids) >= SHARD_DOCS:
                    yield batch()
                    ids, counts, lengths, postings = [], [], [], 0
        if ids:
            yield batch()

    rows = named.mapInArrow(shards, f"ids array<{kind.simpleString()}>, {_INDEX}")
    return materialize(rows, "lexical_index", **_CHECKED | {"parquet.block.size": GROUP_BYTES})


class Shard:
    """A shard with its block maxima, which unpacks blocks when they are asked for."""

    def __init__(self, row: dict, documents: int, total: int):
        unpack = zstandard.ZstdDecompressor().decompress
        self.ids = row["ids"]
        self.norm = norms(np.frombuffer(unpack(row["lengths"]), "<i8"), documents, total)
        self.lists = {t: i for i, t in enumerate(row["terms"])}
        self.first = np.cumsum([0, *(-(-n // BLOCK) for n in row["df"])])
        self.last = np.frombuffer(unpack(row["last"]), "<u2").astype(np.int64)
        block, tf, length = np.frombuffer(unpack(row["edges"]), "<i8").reshape(3, -1)
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        self.most = np.maximum.reduceat(impacts(tf, norms(length, documents, total)), starts)
        self.bound = np.maximum.reduceat(self.most, self.first[:-1])
        self.offsets = np.frombuffer(unpack(row["offsets"]), "<i8")
        self.payload, self.unpack = row["payload"], unpack
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """``(places, impacts)`` of one block."""
        if number not in self.held:
            data = self.unpack(self.payload[self.offsets[number] : self.offsets[number + 1]])
            many = len(data) // 6
            places = np.frombuffer(data, "<u2", many).astype(np.int64)
            self.held[number] = places, impacts(np.frombuffer(data, "<u4", many, 2 * many).astype(np.int64), self.norm[places])
        return self.held[number]


@dataclass
class Best:
    """The best ``k`` documents of one query so far, as ``(-score, id is not null, id)``."""

    k: int
    rows: list[tuple] = field(default_factory=list)

    @property
    def threshold(self) -> int:
        """A document below this score is not among the best; one at this score may be, by its id."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        found = [(-s, i is not None, i) for s, i in zip(scores.tolist(), ids, strict=True)]
        # Nulls compare by their flag alone.
        self.rows = heapq.nsmallest(self.k, [*self.rows, *found], key=lambda r: (r[0], r[1], r[2] if r[1] else 0))


def _kth(scores: np.ndarray, k: int) -> int:
    """The k-th best of some partial scores, which the k-th best document reaches at least; 1 of fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 1


def search_shard(shard: Shard, query: list[tuple[bytes, int]], best: Best) -> None:
    """Add the documents of the shard to the best of a query of ``(term, weight)``."""
    lists = sorted((w * int(shard.bound[i]), w, i) for t, w in query if (i := shard.lists.get(t)) is not None)
    upto = np.cumsum([0, *(bound for bound, _, _ in lists)]).tolist()
    threshold = best.threshold
    score, found = np.zeros(len(shard.norm), np.int64), np.empty(0, np.int64)
    # A list is essential while it and the lesser ones could make a document reach the threshold.
    essential = len(lists)
    while essential and upto[essential] >= threshold:
        essential -= 1
        _, weight, i = lists[essential]
        for number in range(shard.first[i], shard.first[i + 1]):
            places, impact = shard.block(number)
            score[places] += weight * impact
        found = np.flatnonzero(score)
        threshold = max(threshold, _kth(score[found], best.k))
    own = score[found]
    for at in range(essential - 1, -1, -1):
        _, weight, i = lists[at]
        low, high = shard.first[i], shard.first[i + 1]
        place = low + np.searchsorted(shard.last[low:high], found)
        held = place < high
        bound = own + upto[at]
        bound[held] += weight * shard.most[place[held]]
        keep = bound >= threshold
        found, own, place, held = found[keep], own[keep], place[keep], held[keep]
        for number in np.unique(place[held]).tolist():
            places, impact = shard.block(number)
            inside = np.flatnonzero(place == number)
            hit = np.minimum(np.searchsorted(places, found[inside]), len(places) - 1)
            equal = places[hit] == found[inside]
            own[inside[equal]] += weight * impact[hit[equal]]
        threshold = max(threshold, _kth(own, best.k))
    keep = own >= threshold
    found, own = found[keep], own[keep]
    best.add(own, [shard.ids[i] for i in found.tolist()])


def _search_block(index: DataFrame, queries: list[tuple], sizes: tuple[int, int], k: int, kinds: list[DataType]) -> DataFrame:
    """``(number, score, doc)``: the best of each task for queries ``(item, [(term, weight)])``, named by their place."""
    sent = index.sparkSession.sparkContext.broadcast([terms for _, terms in queries])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in sent.value]
        for batch in batches:
            for at in range(batch.num_rows):
                shard = Shard(batch.slice(at, 1).to_pylist()[0], *sizes)
                for query, own in zip(sent.value, best, strict=True):
                    search_shard(shard, query, own)
        for number, own in enumerate(best):
            if own.rows:
                columns = [[number] * len(own.rows), [-r[0] for r in own.rows], [r[2] for r in own.rows]]
                types = [pa.int64(), pa.int64(), to_arrow_type(kinds[0])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["number", "score", "doc"])

    heaps = index.mapInArrow(search, f"number long, score long, doc {kinds[0].simpleString()}")
    order = [F.desc("score"), F.asc("doc")]
    part = Window.partitionBy("number", "part").orderBy(*order)
    heaps = heaps.withColumn("part", F.spark_partition_id() % MERGED)
    heaps = heaps.withColumn("i", F.row_number().over(part)).where(F.col("i") <= k)
    whole = Window.partitionBy("number").orderBy(*order)
    merged = heaps.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)
    named = index.sparkSession.createDataFrame(
        [(number, item) for number, (item, _) in enumerate(queries)], f"number long, item {kinds[1].simpleString()}"
    )
    return merged.join(named, "number").select("item", "rank", "doc", "score")


def search_index(
    index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", k: int = 20, query_bytes: int = QUERY_BYTES
) -> DataFrame:
    """``(item, rank, doc, score)``: the ``k`` best documents of an index for each item; see ``ranked_search``."""
    spark = index.sparkSession
    ship_package(spark)
    kinds = [index.schema["ids"].dataType.elementType, items.schema[item_col].dataType]
    sizes = index.agg(F.sum("docs").alias("n"), F.sum("total").alias("l")).first()
    asked = items.select(F.col(item_col).alias("item"), text_or_empty(text_col).cast("binary").alias("text")).where("octet_length(text) > 0").distinct()
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(total // query_bytes) + 1
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    schema = f"item {kinds[1].simpleString()}, rank int, doc {kinds[0].simpleString()}, score long"
    if not sizes.n:
        return spark.createDataFrame([], schema)
    found = None
    for block in range(blocks):
        texts = [(r.item, Counter(terms_of(bytes(r.text)))) for r in numbered.where(F.col("block") == block).collect()]
        # At most as many distinct terms as fit into the block's bytes.
        wanted = spark.createDataFrame([(t,) for t in {t for _, c in texts for t in c}], "term binary")
        seen = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), "x.df")
        counts = seen.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).collect()
        weight = {bytes(r.term): int(np.floor(1000 * np.log((2 * sizes.n + 2) / (2 * r.df + 1)))) for r in counts}
        queries = [(item, [(t, n * weight[t]) for t, n in c.items() if weight.get(t)]) for item, c in texts]
        part = _search_block(index, [q for q in queries if q[1]], (sizes.n, sizes.l), k, kinds)
        part = materialize(part, "ranked") if blocks > 1 else part
        found = part if found is None else found.unionByName(part)
    return found


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = 20,
) -> DataFrame:
    """``(<item_col>, rank, <id_col>, score)``: the ``k`` documents with the highest scores above 0 for each item.

    Equal scores rank by ascending id, a null one first.  A term that an item repeats counts as often.
    Null and empty texts, and those without a letter or digit, are no documents and ask for nothing.
    Rows of documents with one id are documents of their own; equal rows of items are one item, and
    rows with one id and different texts are ranked each by itself.  Very long texts are taken whole.
    Empty tables give no rows.  Other columns are not read.
    """
    found = search_index(build_index(docs, id_col, text_col), items, item_col, item_text_col, k)
    return found.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
