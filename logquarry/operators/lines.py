"""Line tables: numbering, byte offsets, ranges, levels and counts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.functions.paths import file_name
from logquarry.functions.text import (
    cut_bytes,
    decode_bytes,
    is_cut,
    lenient_charsets,
    log_level,
    strip_bom,
    strip_line_end,
)
from logquarry.plans.blocked import id_block, with_running
from logquarry.plans.skew import BROADCAST_ROWS
from logquarry.session import materialize, materialize_counting, ship_package

COPY_BYTES = 1 << 20


def line_pieces(text: Column) -> Column:
    """Lines of a text: a line feed ends one, an empty rest is none."""
    pieces = F.split(text, "\n")
    last = F.element_at(pieces, -1)
    return F.when(last == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)


def split_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Explode a text column into ``line_no, content`` rows.

    Everything happens inside the row, so nothing is shuffled.
    """
    keep = [c for c in df.columns if c != text]
    exploded = df.select(*keep, F.posexplode(line_pieces(F.col(text))).alias("_pos", "_line"))
    shown = F.when(F.col("_pos") == 0, strip_bom(F.col("_line"))).otherwise(F.col("_line"))
    return exploded.select(
        *keep, (F.col("_pos") + 1).cast("bigint").alias("line_no"), strip_line_end(shown).alias("content")
    )


def number_blocks(raw: DataFrame, charset: bool = False) -> DataFrame:
    """Add 1-based ``line_no`` to rows of ``path, block_start, row_id, ...``.

    With ``charset``, add that too: UTF-8 for a file whose ``raw`` bytes all are,
    else GB18030.  It comes out of the first pass and looks at every byte.

    First pass: one partial aggregate per file block gives its number of lines.
    A running sum over the blocks of a file turns these into first numbers, and
    the second pass adds the row's place in its block.  No line is shuffled when
    the block table is small; otherwise lines meet their block by (file, block),
    a key that never holds more than one input split.

    Both passes read the same splits.  Should a file change in between, a row
    would fall outside its block, and the job stops rather than misnumber lines.
    """
    facts = [F.count(F.lit(1)).alias("_n"), F.min("row_id").alias("_first")]
    if charset:
        facts.append(F.every(F.is_valid_utf8(F.col("raw").cast("string"))).alias("_utf8"))
    counts = raw.groupBy("path", "block_start").agg(*facts)
    before = (
        Window.partitionBy("path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    )
    blocks, seen = materialize_counting(counts, "line_blocks", n=F.count(F.lit(1)))
    bases = blocks.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if charset:
        whole = F.every("_utf8").over(Window.partitionBy("path"))
        bases = bases.withColumn("charset", F.when(whole, "UTF-8").otherwise("GB18030")).drop("_utf8")
    small = seen["n"] <= BROADCAST_ROWS
    joined = raw.join(F.broadcast(bases) if small else bases, ["path", "block_start"])
    place = F.col("row_id") - F.col("_first")
    inside = (place >= 0) & (place < F.col("_n"))
    number = F.when(inside, F.col("_base") + place + 1).otherwise(
        F.raise_error(F.lit("a file changed while its lines were numbered")).cast("bigint")
    )
    return joined.withColumn("line_no", number).drop("_n", "_first", "_base", "row_id", "block_start")


def finish_lines(raw: DataFrame, charset: str | Column | None = None, limit: int | None = None) -> DataFrame:
    """Turn raw bytes (line end included in ``raw_len``) into shown lines.

    With a ``limit``, bytes are cut before they are decoded; the flag looks at the raw length.
    """
    chosen = F.lit(charset or "UTF-8") if charset is None or isinstance(charset, str) else charset
    with lenient_charsets(raw.sparkSession):
        decoded = raw.withColumn("_text", decode_bytes(F.col("raw") if limit is None else cut_bytes(F.col("raw"), limit), chosen))
    text = F.when(F.col("line_no") == 1, strip_bom(F.col("_text"))).otherwise(F.col("_text"))
    return decoded.withColumn("content", strip_line_end(text)).withColumn(
        "truncated", F.lit(False) if limit is None else is_cut(F.col("raw_len"), limit)
    ).drop("_text", "raw")


def number_lines(df: DataFrame, keys: list[str], order: str, block: Column) -> DataFrame:
    """1-based ``line_no`` per file over rows ordered by ``order``."""
    return with_running(df, keys, order, block, position="line_no")


def line_offsets(df: DataFrame, keys: list[str], order: str, block: Column, content: str) -> DataFrame:
    """``byte_start`` and ``byte_len`` of each line, its line feed included.

    Only lengths are shuffled; the text stays where it is.
    """
    slim = df.select(*keys, order, (F.octet_length(content) + 1).cast("bigint").alias("byte_len"))
    return with_running(slim, keys, order, block, position="line_no", sums={"byte_start": F.col("byte_len")})


def raw_lengths(index: DataFrame, keys: list[str], order: str = "line_no") -> DataFrame:
    """Length of a line from the offsets: next start minus own start.

    ``index`` may hold no lengths; the last line of a file has none.
    """
    following = with_running(index, keys, order, id_block(order), following={"_next": "byte_start"})
    return following.withColumn("raw_len", F.col("_next") - F.col("byte_start")).drop("_next")


def read_range(lines: DataFrame, start: int, count: int) -> DataFrame:
    """Lines ``start + 1`` to ``start + count``; nothing beyond the last line."""
    return lines.where(F.col("line_no").between(start + 1, start + count))


def first_lines(lines: DataFrame) -> DataFrame:
    """The first line of every file."""
    return lines.where(F.col("line_no") == 1)


def line_counts(lines: DataFrame, key: str = "path") -> DataFrame:
    """Lines per file."""
    return lines.groupBy(key).agg(F.count(F.lit(1)).alias("n_lines"))


def with_level(lines: DataFrame, content: str = "content") -> DataFrame:
    """Add the log level of each line."""
    return lines.withColumn("level", log_level(F.col(content)))


def export_lines(lines: DataFrame, published: int, folder: str) -> DataFrame:
    """Copy the first ``published`` lines of every file, byte for byte, into a folder.

    ``lines`` holds ``path, line_no, raw_len`` of files that tasks can open.  One row
    for each file: ``path, target, n_lines, bytes, complete``, ``bytes`` being those
    written.  A copy is finished under another name and then moved into place, so a
    task that runs twice leaves one whole file.
    """
    wanted = F.col("line_no") <= published
    spans = lines.groupBy("path").agg(
        F.count_if(wanted).alias("n_lines"),
        F.coalesce(F.sum(F.when(wanted, F.col("raw_len"))), F.lit(0)).cast("bigint").alias("upto"),
        (F.max("line_no") <= published).alias("complete"),
    )
    target = F.concat(F.lit(f"{folder.rstrip('/')}/"), F.sha1(F.col("path").cast("binary")), F.lit("-"), file_name(F.col("path")))
    ship_package(lines.sparkSession)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = batch.to_pydict()
            sizes = [copy_prefix(*row) for row in zip(table["path"], table["target"], table["upto"])]
            names = ["path", "target", "n_lines", "complete"]
            columns = [*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "bytes"])

    schema = "path string, target string, n_lines bigint, complete boolean, bytes bigint"
    return materialize(spans.withColumn("target", target).repartition("path").mapInArrow(copy, schema), "exports")


def copy_prefix(path: str, target: str, size: int) -> int:
    """Copy at most ``size`` bytes of a file and return how many there were."""
    source, inside = fs.FileSystem.from_uri(path)
    store, place = fs.FileSystem.from_uri(target)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    unfinished, left = f"{place}.{uuid.uuid4().hex}", size
    with source.open_input_stream(inside) as data, store.open_output_stream(unfinished) as out:
        while left and (piece := data.read(min(left, COPY_BYTES))):
            out.write(piece)
            left -= len(piece)
    store.move(unfinished, place)
    return size - left
