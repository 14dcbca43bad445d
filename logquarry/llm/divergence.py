"""How the sources of a language differ in the terms they use, with late string materialization.

In a first map every document gives the 64-bit digests of its terms, and nothing else is shuffled to
find those that enough documents of the language hold.  A bitmap of fixed size of these stops all other
terms in a second map, which counts the rest by digest; a term's string leaves it once for some ten
thousand terms.  Where the least and the greatest string of a digest differ, the digest stands for several
terms, and its counts are made again by string.  Text comes back at the end, for the terms that are
part of the result.

Sums over all pairs of sources are made next to the counts: a task reads the counts of one slice of
the terms, for two tiles of sources at a time, and gives one row for each pair of sources, not one for
each term and pair.  Terms that neither source uses are all worth the same and are only counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Window_
from pyspark.sql import functions as F

from logquarry.llm.common import FILTER_BITS, PIECE_BITS, materialize, materialize_counting, quoted, rows_of, ship_package, text_or_empty

# Pairs of a document and a term, and distinct terms, that a task counts at once.
WINDOW_PAIRS = 4_000_000
WINDOW_TERMS = 600_000
# Sources of a tile: two tiles and a pair table of this side are what a task holds.
TILE = 256
# Terms of a dense table of counts.
DENSE_TERMS = 1024
SCALE = 1_000_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and of all other characters beyond ASCII, with A-Z in lower case."""
    return text.translate(_KEEP).split()


def digests_of(terms: list[bytes], bits: int) -> np.ndarray:
    """The digests of terms, of so many bits."""
    return np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64, len(terms)) >> np.uint64(64 - bits)


def within(digests: np.ndarray, lang: str) -> np.ndarray:
    """Keys of digests in one language."""
    mixed = (digests ^ np.uint64(xxhash.xxh64_intdigest(lang, 1))) * _ODD
    return mixed ^ (mixed >> np.uint64(32))


class Numbers(dict):
    """A number for each thing asked for, in the order in which they come."""

    def __missing__(self, thing) -> int:
        self[thing] = number = len(self)
        return number


@dataclass
class Window:
    """Some documents in numbers: the document, term and number of occurrences of each pair of a document and a term."""

    terms: list[bytes]
    groups: list[tuple[str, str]]
    group_of: np.ndarray
    doc: np.ndarray
    term: np.ndarray
    n: np.ndarray

    def summed(self, owner: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """``(owner, term, occurrences, documents)`` by the owners of documents, of all pairs or those to keep."""
        doc, term, n = (x if keep is None else x[keep] for x in (self.doc, self.term, self.n))
        code = owner[doc].astype(np.int64) * len(self.terms) + term
        order = np.argsort(code, kind="stable")
        code, n = code[order], n[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        docs = np.diff(np.append(first, len(code)))
        own, term = np.divmod(code[first], len(self.terms))
        return own, term, np.add.reduceat(n, first, dtype=np.int64) if len(first) else n[:0], docs


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[Window]:
    """The terms of ``(lang, source, text)`` rows, some documents at a time."""
    terms, groups, parts, counts, owners, waiting = Numbers(), Numbers(), [], [], [], 0

    def window() -> Window:
        doc = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        return Window(list(terms), list(groups), np.array(owners), doc, np.concatenate(parts), np.concatenate(counts))

    for lang, source, text in rows_of(batches, 256):
        if words := terms_of(text):
            own, n = np.unique(np.fromiter(map(terms.__getitem__, words), np.int32, len(words)), return_counts=True)
            parts.append(own)
            counts.append(n.astype(np.int32))
            owners.append(groups[lang, source])
            waiting += len(own)
            if waiting >= WINDOW_PAIRS or len(terms) >= WINDOW_TERMS:
                yield window()
                terms, groups, parts, counts, owners, waiting = Numbers(), Numbers(), [], [], [], 0
    if parts:
        yield window()


def document_keys(docs: DataFrame, digest_bits: int) -> DataFrame:
    """``(key, docs)`` of ``(lang, source, text)``: how many documents of a few hold each term of a language.

    Terms of one digest count each, so a key may have more than there are documents, never fewer.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in windows(batches):
            langs = Numbers()
            own, term, _, docs = w.summed(np.array([langs[lang] for lang, _ in w.groups])[w.group_of])
            digests = digests_of(w.terms, digest_bits)[term]
            key = np.empty(len(own), np.uint64)
            for lang, number in langs.items():
                key[own == number] = within(digests[own == number], lang)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(docs, pa.int64())], ["key", "docs"])

    return docs.mapInArrow(keys, "key long, docs long")


def bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """The bitmap of a column of numbers, of ``FILTER_BITS`` bits however many there are."""
    place = F.pmod(F.col(key), F.lit(FILTER_BITS))
    pieces = keys.select(F.floor(place / PIECE_BITS).alias("piece"), (place % PIECE_BITS).alias("bit"))
    out = np.zeros((FILTER_BITS // PIECE_BITS, PIECE_BITS // 8), np.uint8)
    for row in pieces.groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        out[row.piece] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)


def among(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which keys may be in a bitmap: all those that are, and few others."""
    place = keys & np.uint64(FILTER_BITS - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def tallies(docs: DataFrame, bits: np.ndarray, digest_bits: int, by_string: bool = False) -> DataFrame:
    """``(lang, source, digest, term, n, docs)`` of ``(lang, source, text)``: counts of some documents at a time.

    Counts are of the terms whose keys are in the bitmap, or, ``by_string``, whose digests are; the term
    is told by one of the rows of its digest, or by all.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("digest", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in windows(batches):
            digests = digests_of(w.terms, digest_bits)
            langs = [lang for lang, _ in w.groups]
            counted = {x: among(digests if by_string else within(digests, x), sent.value) for x in set(langs)}
            table = np.stack([counted[x] for x in langs])
            own, term, n, docs = w.summed(w.group_of, table[w.group_of[w.doc], w.term])
            told = np.ones(len(term), bool)
            if not by_string:
                told[:] = False
                told[np.unique(term, return_index=True)[1]] = True
            names = pa.array([w.terms[t] if tell else None for t, tell in zip(term.tolist(), told.tolist(), strict=True)], pa.binary())
            groups = [pa.array([g[i] for g in w.groups], pa.string()).take(pa.array(own)) for i in (0, 1)]
            columns = [*groups, pa.array(digests[term].view(np.int64)), names.cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
            for at in range(0, len(term), 50_000):
                yield pa.RecordBatch.from_arrays([c[at : at + 50_000] for c in columns], schema=schema)

    return docs.mapInArrow(count, "lang string, source string, digest long, term string, n long, docs long")


def kept_terms(docs: DataFrame, least_docs: int, digest_bits: int) -> tuple[DataFrame, DataFrame]:
    """``(lang, source, digest, word, n)`` of every kept term with a count, and ``(digest, word, term)`` of their strings.

    ``word`` is 0, but for digests that stand for several terms, whose terms it numbers.
    """
    # A key stands for one term, or for several: all that are kept are among those with so many documents.
    keys = document_keys(docs, digest_bits).groupBy("key").agg(F.sum("docs").alias("docs"))
    bits = bitmap(keys.where(F.col("docs") >= least_docs), "key")
    counted = materialize(tallies(docs, bits, digest_bits), "term_tallies")
    sums = [F.sum("n").alias("n"), F.sum("docs").alias("docs")]
    many = F.sum("docs") >= least_docs
    by_digest = materialize(counted.groupBy("lang", "source", "digest").agg(*sums), "digest_counts")
    wanted = by_digest.groupBy("lang", "digest").agg(many.alias("many")).where("many").select("lang", "digest")
    wanted = materialize(wanted, "kept_digests")
    digests = wanted.select("digest").distinct()
    told = counted.where("term IS NOT NULL").select("digest", "term").join(digests, "digest", "left_semi")
    strings = told.groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high"))
    strings, seen = materialize_counting(strings, "kept_strings", several=F.count_if(F.col("low") < F.col("high")))
    single = strings.where("low = high")
    names = single.select("digest", F.lit(0).alias("word"), F.col("low").alias("term"))
    found = by_digest.join(wanted, ["lang", "digest"], "left_semi").join(single.select("digest"), "digest", "left_semi")
    found = found.select("lang", "source", "digest", F.lit(0).alias("word"), "n")
    if seen["several"]:
        shared = strings.where("low < high").select("digest")
        split = tallies(docs, bitmap(shared, "digest"), digest_bits, by_string=True).join(shared, "digest", "left_semi")
        split = materialize(split.groupBy("lang", "source", "digest", "term").agg(*sums), "split_counts")
        several = split.groupBy("lang", "digest", "term").agg(many.alias("many")).where("many").select("lang", "digest", "term")
        numbers = Window_.partitionBy("digest").orderBy("term")  # as many as collide
        numbered = several.select("digest", "term").distinct().withColumn("word", F.row_number().over(numbers))
        split = split.join(several, ["lang", "digest", "term"], "left_semi").join(numbered, ["digest", "term"])
        names = names.unionByName(numbered)
        found = found.unionByName(split.select("lang", "source", "digest", "word", "n"))
    return materialize(found, "kept_counts"), names


def share(n: Column, total: Column, terms: Column) -> Column:
    """The share of a term in parts of a thousand million, with two added to every count."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", scaled, (total + 2 * terms).cast("decimal(20,0)"))


def gap(p: Column, q: Column) -> Column:
    """What a term with shares ``p`` and ``q`` adds."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``gap`` of arrays."""
    return (p - q) ** 2 // (p + q)


def pair_sums(used: DataFrame, groups: DataFrame, slices: int) -> DataFrame:
    """``(lang_no, a, b, value)`` with ``a < b``: sums over the terms that a or b uses, less what unused ones would give.

    ``used`` holds ``(lang_no, source_no, digest, word, p)`` and ``groups`` ``(lang_no, source_no, p0)``, the
    share of an unused term; sources are numbered from 0 in each language.
    """
    tiles = groups.groupBy("lang_no").agg((F.floor(F.max("source_no") / TILE) + 1).cast("int").alias("tiles"))
    own = F.floor(F.col("source_no") / TILE).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    sides = [F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    keys = ["lang_no", "i", "j", "slice"]
    # The unused shares of the sources come first, without a digest, to each slice of two tiles.
    heads = groups.join(tiles, "lang_no").select("lang_no", "source_no", F.col("p0").alias("p"), own.alias("own"), other)
    heads = heads.select("lang_no", *sides, "source_no", "p", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    heads = heads.withColumns({"digest": F.lit(None).cast("long"), "word": F.lit(0)})
    slice_of = F.pmod(F.xxhash64("digest", "word"), F.lit(slices)).cast("int").alias("slice")
    rows = used.join(F.broadcast(tiles), "lang_no").select("lang_no", "source_no", "digest", "word", "p", slice_of, own.alias("own"), other)
    rows = rows.select("lang_no", *sides, "source_no", "p", "slice", "digest", "word")
    dealt = heads.unionByName(rows).select(*keys, "digest", "word", "source_no", "p").repartition(*keys)
    dealt = dealt.sortWithinPartitions(*keys, F.col("digest").asc_nulls_first(), "word")
    schema = pa.schema([("lang_no", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, table = None, None
        for batch in batches:
            heads = batch.column(4).is_null().to_numpy(zero_copy_only=False)
            columns = [c.fill_null(0).to_numpy(zero_copy_only=False) for c in batch.columns]
            place = np.stack(columns[:4])
            edges = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                now = tuple(place[:, a].tolist())
                if now != key:
                    if table is not None:
                        yield from table.rows(key[0], schema)
                    key, table = now, PairTable(now[1], now[2], TILE)
                head = a + int(heads[a:b].sum())
                digest, word, source, p = columns[4:]
                table.zeros(source[a:head], p[a:head])
                table.add(digest[head:b], word[head:b], source[head:b], p[head:b])
        if table is not None:
            yield from table.rows(key[0], schema)

    found = dealt.mapInArrow(sums, "lang_no int, a int, b int, value long")
    return found.groupBy("lang_no", "a", "b").agg(F.sum("value").alias("value"))


class PairTable:
    """Sums for the pairs of two tiles of sources, over terms that come one after the other."""

    def __init__(self, i: int, j: int, tile: int):
        self.starts, self.tile = (i * tile, j * tile), tile
        # Shares by place: the first tile's sources, then the second one's where it is another.
        self.width = tile if i == j else 2 * tile
        self.right = 0 if i == j else tile
        self.base = np.zeros(self.width, np.int64)
        self.total = np.zeros((tile, self.width - self.right), np.int64)
        self.dense, self.row, self.last = None, -1, None

    def places(self, sources: np.ndarray) -> np.ndarray:
        inside = sources - self.starts[0]
        return np.where(inside < self.tile, inside, sources - self.starts[1] + self.right)

    def zeros(self, sources: np.ndarray, shares: np.ndarray) -> None:
        self.base[self.places(sources)] = shares

    def add(self, digests: np.ndarray, words: np.ndarray, sources: np.ndarray, shares: np.ndarray) -> None:
        """Terms in order: those of one term lie together, the last term may go on."""
        if not len(digests):
            return
        if self.dense is None:
            self.held = np.flatnonzero(self.base)
            self.dense = np.tile(self.base, (DENSE_TERMS, 1))
        fresh = np.ones(len(digests), bool)
        fresh[1:] = (digests[1:] != digests[:-1]) | (words[1:] != words[:-1])
        fresh[0] = self.last != (int(digests[0]), int(words[0]))
        self.last = int(digests[-1]), int(words[-1])
        term, at = self.row + np.cumsum(fresh), self.places(sources)
        begin = 0
        while begin < len(term):
            end = begin + int(np.searchsorted(term[begin:], DENSE_TERMS, "left"))
            self.dense[term[begin:end], at[begin:end]] = shares[begin:end]
            if end > begin:
                self.row = int(term[end - 1])
            if end < len(term):
                self.flush()
                term = term - term[end]
            begin = end
        # A term that goes on stays; a full table is emptied when the next term comes.

    def flush(self) -> None:
        used = self.dense[: self.row + 1]
        others = self.held[self.held >= self.right]
        for k in self.held[self.held < self.tile].tolist():
            spread = gaps(used[:, k : k + 1], used[:, others]).sum(axis=0)
            self.total[k, others - self.right] += spread - gaps(self.base[k], self.base[others]) * len(used)
        self.dense[:] = self.base
        self.row = -1

    def rows(self, lang: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if self.dense is None:
            return
        self.flush()
        first, second = self.held[self.held < self.tile], self.held[self.held >= self.right]
        one, two = (x.reshape(-1) for x in np.meshgrid(first, second, indexing="ij"))
        a = one + self.starts[0]
        b = two + self.starts[0] if not self.right else two - self.right + self.starts[1]
        keep = a < b
        values = self.total[one, two - self.right][keep]
        if len(values):
            names = [pa.array(np.full(len(values), lang, np.int32)), pa.array(a[keep].astype(np.int32)), pa.array(b[keep].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*names, pa.array(values)], schema=schema)


def source_divergence(
    docs: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    least_docs: int = 10,
    top_terms: int = 10,
    digest_bits: int = 64,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how each source of a language differs from the others and from the whole.

    A language keeps the terms that at least ``least_docs`` of its documents (rows) hold.  A group
    (a language's source, or the language) gives a term of ``n`` occurrences among its ``total`` of kept
    terms the share ``1 + floor(10**9 * (n + 2) / (total + 2 * terms))``; two shares differ by
    ``floor((p - q)**2 / (p + q))``.  Part ``pair`` has, for every other source of the language, the sum
    over all kept terms; part ``term`` the ``top_terms`` kept terms that the source holds and gives a greater share
    than the language.  Ranks go by value, greatest first, then by item in UTF-8 order.

    Null texts, languages and sources are empty ones; a group without terms takes part in pairs.
    Repeated rows count each; very long texts are taken whole.  An empty table gives no rows.  Other
    columns are not read.  ``digest_bits`` below 64 makes digests collide, for tests.
    """
    spark = docs.sparkSession
    ship_package(spark)
    lang, source = (text_or_empty(quoted(c)).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source")))
    texts = docs.select(lang, source, text_or_empty(quoted(text_col)).cast("binary").alias("text"))
    counts, names = kept_terms(texts, least_docs, digest_bits)

    # One row for each group and language, also without a kept term.
    terms = counts.select("lang", "digest", "word").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(lang, source).distinct().join(totals, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    # Each group is one row here, of which the result has one for every pair.
    numbers = Window_.partitionBy("lang").orderBy("source")
    langs = groups.select("lang").distinct().withColumn("lang_no", (F.row_number().over(Window_.orderBy("lang")) - 1).cast("int"))
    unused = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).alias("p0")
    numbered = groups.join(langs, "lang").select("*", (F.row_number().over(numbers) - 1).cast("int").alias("source_no"), unused)
    groups = materialize(numbered, "groups")

    shares = counts.join(groups, ["lang", "source"]).select(
        "lang_no", "source_no", "digest", "word", "n", share(F.col("n"), F.col("total"), F.col("terms")).alias("p")
    )
    shares = materialize(shares, "shares")
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = pair_sums(shares.drop("n"), groups.where("terms > 0").select("lang_no", "source_no", "p0"), slices)
    one = groups.select("lang", "lang_no", F.col("source").alias("source_a"), F.col("source_no").alias("a"), F.col("p0").alias("p_a"), "terms")
    two = groups.select("lang_no", F.col("source").alias("source_b"), F.col("source_no").alias("b"), F.col("p0").alias("p_b"))
    pairs = one.join(two, "lang_no").where("a < b").join(sums, ["lang_no", "a", "b"], "left")
    flat = F.when(F.col("terms") > 0, F.col("terms") * gap(F.col("p_a"), F.col("p_b"))).otherwise(0)
    pairs = pairs.select("lang", "source_a", "source_b", (flat + F.coalesce("value", F.lit(0))).alias("value"))
    both = [
        pairs.select("lang", F.col(f"source_{x}").alias("source"), F.lit("pair").alias("part"), F.col(f"source_{y}").alias("item"), "value")
        for x, y in ("ab", "ba")
    ]
    pair_order = Window_.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pair_part = both[0].unionByName(both[1]).withColumn("rank", F.row_number().over(pair_order))

    whole = shares.groupBy("lang_no", "digest", "word").agg(F.sum("n").alias("all"))
    sizes = groups.groupBy("lang_no").agg(F.sum("total").alias("size"), F.max("terms").alias("terms"))
    whole = whole.join(sizes, "lang_no").select("lang_no", "digest", "word", share(F.col("all"), F.col("size"), F.col("terms")).alias("q"))
    over = shares.join(whole, ["lang_no", "digest", "word"]).where("p > q")
    over = over.select("lang_no", "source_no", "digest", "word", gap(F.col("p"), F.col("q")).alias("value"))
    # Ranked by value first, so that only the best and their ties get their strings.
    best = Window_.partitionBy("lang_no", "source_no").orderBy(F.desc("value"))
    first = over.withColumn("r", F.rank().over(best)).where(F.col("r") <= top_terms)
    named = first.join(groups.select("lang_no", "source_no", "lang", "source"), ["lang_no", "source_no"])
    texts = named.join(names, ["digest", "word"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    term_order = Window_.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    term_part = texts.withColumn("rank", F.row_number().over(term_order)).where(F.col("rank") <= top_terms)
    return pair_part.unionByName(term_part)
