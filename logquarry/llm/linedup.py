"""Line dedup over the whole corpus by a deletion-neighbourhood join.

A line goes when an earlier line (by id, then line number) has the same words, or differs by one
word put in, left out or replaced and both have at least ``min_words`` words (so that four words in
five agree).  Every candidate line emits its deletion neighbourhood: the hash of all its words and,
for each word, the hash of the line without it.  Equal hashes bring near lines together:

* a line and one that lacks a word share the latter's own hash;
* two lines that differ in word ``i`` share the hash without word ``i``, at the same position.

So the earliest line of each (hash, position) and of each whole-line hash is a witness for all
others: minima, not pairs.  The edit distance to the witness is then computed on the words.

Lines that cannot have a partner emit nothing: of two lines within one edit, the first or the last
half of the shorter one's words is equal, and a line none of whose halves occurs in another line is
left out beforehand.  That test loses nothing and keeps the neighbourhoods to a small share of the
text.  Of the texts only the lines that are left travel, told by their places at a bitmap, and at the
end the documents that lose a line; all others stay where they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import materialize, maybe_among, passing, quoted, ship_package, text_or_empty

SPACE = r"[\x20\x09-\x0D]+"
ORDER = ["doc", "body", "line_no"]
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(line: Column) -> Column:
    """The words of a line, between ASCII white space."""
    return F.array_remove(F.split(line, SPACE), "")


def neighbourhood(words: list[bytes]) -> np.ndarray:
    """The hash of all words, then for each word the hash of the others in order."""
    size = len(words)
    power = np.cumprod(np.full(size, _BASE))
    codes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, size)
    here, shifted = codes * power, codes * np.concatenate([np.ones(1, np.uint64), power[:-1]])
    before = np.concatenate([[np.uint64(0)], np.cumsum(here, dtype=np.uint64)])
    after = np.concatenate([np.cumsum(shifted[::-1], dtype=np.uint64)[::-1], [np.uint64(0)]])
    sums = np.concatenate([before[-1:], before[:-1] + after[1:]])
    lengths = np.full(size + 1, size - 1, np.uint64)
    lengths[0] = size
    return (sums ^ (sums >> np.uint64(31))) * _BASE + lengths


def within_one_edit(a: list, b: list) -> bool:
    """Whether the word edit distance is at most one."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def _halves(n: Column, words: Column, min_words: int) -> list[Column]:
    """Four hashes: first and last half of the words, for a partner as long or longer, and for a shorter one."""
    out = []
    for size in (n, n - 1):
        half = F.floor(size / 2).cast("int")
        for side, part in enumerate((F.slice(words, 1, half), F.slice(words, n - half + 1, half))):
            out.append(F.when(size >= min_words, F.xxhash64(size, F.lit(side), part)))
    return out


def _occurrences(docs: DataFrame) -> DataFrame:
    """``(doc, body, line_no, words, n, line)`` of every line that has words; ``line`` hashes the words."""
    lines = docs.select("doc", "body", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    lines = lines.select(*ORDER, words_of(F.col("raw")).alias("words")).withColumn("n", F.size("words")).where("n > 0")
    return lines.withColumn("line", F.xxhash64("words"))


def _suspects(first: DataFrame) -> DataFrame:
    """``line`` hashes of distinct lines that share a half with another one."""
    shared = first.select("line", F.explode(F.array("h0", "h1", "h2", "h3")).alias("half")).where("half IS NOT NULL")
    ends = shared.groupBy("half").agg(F.min("line").alias("low"), F.max("line").alias("high")).where("low <> high")
    return shared.join(ends.select("half"), "half", "left_semi").select("line").distinct()


def _suspect_lines(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(doc, body, line_no, line, text)`` of the chosen ``(doc, body, line_no, line)``."""
    # Documents without a chosen line are not split, lines not chosen are not shuffled.
    held = passing(docs, chosen.select("doc", "body").distinct(), "doc", "body")
    lines = held.select("doc", "body", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    lines = passing(lines, chosen, *ORDER)
    wanted = chosen.select(*[F.col(c).alias(f"_{c}") for c in ORDER], "line")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) if c == "doc" else F.col(c) == F.col(f"_{c}") for c in ORDER]
    # Repeated rows give a line twice.
    return lines.join(wanted, same).select(*ORDER, "line", "text").dropDuplicates(["line"])


def _neighbourhoods(lines: DataFrame) -> DataFrame:
    """``(key, pos, line)``: the deletion neighbourhood of each line; position -1 is the whole line."""

    @F.pandas_udf("array<long>")
    def keys(texts: pd.Series) -> pd.Series:
        return pd.Series([neighbourhood(t.encode("utf-8", "surrogatepass").split()).view(np.int64) for t in texts], dtype=object)

    return lines.select("line", F.posexplode(keys("text")).alias("pos", "key")).withColumn("pos", F.col("pos") - 1)


def near_lines(lines: DataFrame) -> DataFrame:
    """``line`` hashes of those ``(doc, body, line_no, line, text)`` that have an earlier line within one edit."""
    lines = materialize(lines, "suspect_lines")
    every = _neighbourhoods(lines)
    # Most hashes belong to one line: only the others are kept, with the places of their lines.
    met = every.groupBy("key").agg(F.min("line").alias("low"), F.max("line").alias("high")).where("low < high")
    places = lines.select("line", F.struct(*ORDER, "line").alias("own"))
    members = every.join(met.select("key"), "key", "left_semi").join(places, "line").select("key", "pos", "own")
    members = materialize(members, "neighbours")
    spots = members.groupBy("key", "pos").agg(F.min("own").alias("low"), F.max("own").alias("high"))
    spots = materialize(spots, "spots")
    whole = spots.where("pos = -1").select("key", F.col("low").alias("whole"))
    lacking = spots.where("pos >= 0").groupBy("key").agg(F.min("low").alias("lacking"))
    around = whole.join(lacking, "key").select("key", "whole", "lacking")
    near = spots.join(around, "key", "left").select(
        "key",
        "pos",
        F.when(F.col("pos") < 0, F.col("lacking")).otherwise(F.least("low", "whole")).alias("witness"),
        "high",
    )
    near = near.where("witness < high").select("key", "pos", "witness")
    pairs = members.join(near, ["key", "pos"]).where("witness < own")
    pairs = pairs.select(F.col("own.line").alias("line"), F.col("witness.line").alias("other")).distinct()
    mine = lines.select("line", F.col("text").alias("a"))
    theirs = lines.select(F.col("line").alias("other"), F.col("text").alias("b"))

    @F.pandas_udf("boolean")
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        # bytes.split() cuts at ASCII white space only
        sides = zip(a.str.encode("utf-8", "surrogatepass"), b.str.encode("utf-8", "surrogatepass"), strict=True)
        return pd.Series([within_one_edit(x.split(), y.split()) for x, y in sides], dtype=bool)

    return pairs.join(mine, "line").join(theirs, "other").where(verified("a", "b")).select("line").distinct()


def removed_lines(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """``(doc, body, gone)``: the line numbers to leave out of each document of ``(doc, body, text)``."""
    lines = _occurrences(docs)
    halves = [half.alias(f"h{i}") for i, half in enumerate(_halves(F.col("n"), F.col("words"), min_words))]
    # Hashes only, written once: texts are split and hashed in one pass.
    lines = materialize(lines.select(*ORDER, "line", *halves), "lines")
    first = lines.groupBy("line").agg(
        F.min(F.struct(*ORDER, "h0", "h1", "h2", "h3")).alias("f"), F.count(F.lit(1)).alias("times")
    )
    first = materialize(first.select("line", "times", "f.*"), "distinct_lines")
    chosen = first.join(_suspects(first), "line").select(*ORDER, "line")
    near = materialize(near_lines(_suspect_lines(docs, chosen)).withColumn("near", F.lit(True)), "near_lines")
    verdicts = first.select("line", "times", *[F.col(c).alias(f"first_{c}") for c in ORDER]).join(near, "line", "left")
    verdicts = verdicts.where("times > 1 OR near").select("line", "near", *[f"first_{c}" for c in ORDER])
    kept = F.lit(True)
    for c in ORDER:
        kept = kept & F.col(c).eqNullSafe(F.col(f"first_{c}"))
    gone = lines.select(*ORDER, "line").join(verdicts, "line").where(F.coalesce("near", F.lit(False)) | ~kept)
    return gone.groupBy("doc", "body").agg(F.collect_set("line_no").alias("gone"))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 5,
    removed_col: str | None = None,
) -> DataFrame:
    """``docs`` with later copies of lines left out of the text; all other columns are kept as they are.

    Lines end at ``\\n``.  A line without words stays.  A text that loses all its lines is empty; a null
    text stays null.  Documents are ordered by id, null first, then by a hash of the text, so the result
    does not depend on the order of the rows; rows with equal id and text are one document and get the
    same text.  ``removed_col`` names a column for the number of lines left out.  An empty table gives
    no rows.
    """
    if removed_col in docs.columns:
        raise ValueError(f"there is a column {removed_col} already")
    ship_package(docs.sparkSession)
    text = text_or_empty(quoted(text_col))
    # The other columns in one, so that none of their names can clash.
    others = F.struct(F.lit(0).alias("_"), *[quoted(c) for c in docs.columns if c != text_col]).alias("others")
    whole = docs.select(others, quoted(id_col).alias("doc"), F.xxhash64(text).alias("body"), quoted(text_col).alias("text"))
    named = whole.select("doc", "body", text_or_empty("text").alias("text"))
    gone = materialize(removed_lines(named, min_words), "removed_lines")
    marked = maybe_among(whole, gone, ["doc", "body"], "touched")
    lost = gone.select(F.col("doc").alias("d"), F.col("body").alias("b"), "gone")
    touched = marked.where("touched").join(lost, F.col("doc").eqNullSafe(F.col("d")) & (F.col("body") == F.col("b")), "left")
    none = F.lit(None).cast("array<int>").alias("gone")
    every = touched.select("others", "text", "gone").unionByName(marked.where("NOT touched").select("others", "text", none))
    rebuilt = F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("gone")))
    columns = [(rebuilt if c == text_col else F.col("others").getField(c)).alias(c) for c in docs.columns]
    count = [F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(removed_col)] if removed_col else []
    return every.select(*columns, *count)


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines of these numbers."""

    def kept(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    # An array of one element binds the lines, so that they are split once.
    return F.element_at(F.transform(F.array(F.split(text, "\n")), kept), 1)
