"""A stored, sparse index of the lines of text files, and reads that seek by it.

Files are cut into byte ranges, of which every task scans some for line ends; a running sum over the
ranges of a file turns places into line numbers.  The index is a table of *spans*: where a span of a
file begins, its first line's number and how many lines it has, at most ``every`` lines or about
``span_bytes`` bytes.  A range of lines is read from the spans that hold it alone, and a whole file of any
size by as many tasks as there are spans.

Line ends are those of the file's charset.  UTF-16, told by its byte order mark or by the caller, has
two-byte ones: ranges are even, so no line feed is taken for a half of two characters.  A file without
a mark is UTF-8 where all of its bytes are, else GB18030; a character on the edge of two ranges is put
together from both.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logquarry.constants import BYTE_ORDER_MARKS
from logquarry.functions.text import charset_name
from logquarry.operators.lines import finish_lines
from logquarry.session import materialize, ship_package
from logquarry.sources.files import listing

# A byte range of the first pass, and the bounds of a span.
RANGE_BYTES = 32 << 20
EVERY_LINES = 1_000
SPAN_BYTES = 256 << 10
# Lines of a batch of rows.
BATCH_LINES = 4_096
_MARKS = [(bytes.fromhex(mark), name) for mark, name in BYTE_ORDER_MARKS]
_INDEX = ["path", "line", "lines", "offset", "end", "charset", "n_lines", "size", "modified"]


def opened(path: str):
    """A file of any store that Arrow knows, at whose places one can read."""
    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


def marked_charset(head: bytes) -> str | None:
    """The charset that a byte order mark tells."""
    return next((name for mark, name in _MARKS if head.startswith(mark)), None)


def line_ends(piece: bytes, charset: str | None) -> np.ndarray:
    """Where lines end in a piece: the places behind its line feeds."""
    if charset in ("UTF-16LE", "UTF-16BE"):
        units = np.frombuffer(piece, "<u2" if charset == "UTF-16LE" else ">u2", len(piece) // 2)
        return 2 * np.flatnonzero(units == 10) + 2
    return np.flatnonzero(np.frombuffer(piece, np.uint8) == 10) + 1


@dataclass
class Scanned:
    """What the first pass knows of a byte range."""

    charset: str | None
    ends: int = 0
    #: Places behind line feeds, with the number of line ends of the range up to there.
    marks: list[tuple[int, int]] = field(default_factory=list)
    last_end: int = 0
    utf8: bool = True
    #: Bytes of a character that begins before the range, and of one that ends behind it.
    head: bytes = b""
    tail: bytes = b""


def scan_range(path: str, start: int, end: int, charset: str | None, every: int, span_bytes: int) -> Scanned:
    """The line ends of a byte range of a file."""
    with opened(path) as data:
        found = Scanned(charset or marked_charset(data.read(3)))
        decoder = codecs.getincrementaldecoder("utf-8")("strict")
        data.seek(start)
        at, marked = start, start
        while at < end and (piece := data.read(min(span_bytes, end - at))):
            ends = line_ends(piece, found.charset)
            # The first of a range, every so many lines, and the first of a piece that is far from the last mark.
            numbers = found.ends + 1 + np.arange(len(ends))
            chosen = (numbers % every == 0) | (numbers == (1 if start else 0))
            if len(ends) and at + int(ends[0]) - marked >= span_bytes // 2:
                chosen[0] = True
            found.marks += [(n, at + e) for n, e in zip(numbers[chosen].tolist(), ends[chosen].tolist(), strict=True)]
            if len(ends):
                found.ends += len(ends)
                found.last_end = at + int(ends[-1])
                marked = found.marks[-1][1] if found.marks else marked
            if found.utf8 and found.charset is None:
                text = piece
                if at == start and start:
                    text = piece.lstrip(bytes(range(0x80, 0xC0))) if piece[:1] and 0x80 <= piece[0] < 0xC0 else piece
                    found.head = piece[: len(piece) - len(text)]
                    found.utf8 = len(found.head) <= 3
                try:
                    decoder.decode(text)
                except UnicodeDecodeError:
                    found.utf8 = False
            at += len(piece)
        found.tail = decoder.getstate()[0] if found.utf8 else b""
        return found


def _ranges(files: DataFrame, range_bytes: int, charset: str | None, every: int, span_bytes: int) -> DataFrame:
    """The first pass: a row for each byte range of ``path, size, modified``."""
    if range_bytes % 2 or span_bytes % 2:
        raise ValueError("ranges have an even number of bytes")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    rows = files.select("path", "size", "modified", F.posexplode(starts).alias("part", "start"))
    rows = rows.withColumn("end", F.least(F.col("start") + range_bytes, F.col("size")))
    keep = ["path", "size", "modified", "part"]
    schema = f"path string, size long, modified {files.schema['modified'].dataType.simpleString()}, part int, charset string, ends long, last_end long, utf8 boolean, head binary, tail binary, marks array<struct<n:long,offset:long>>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = pa.list_(pa.struct([("n", pa.int64()), ("offset", pa.int64())]))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), marks]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                path, start, end = (row.column(row.schema.get_field_index(c))[0].as_py() for c in ("path", "start", "end"))
                s = scan_range(path, start, end, charset, every, span_bytes)
                pairs = [{"n": n, "offset": at} for n, at in s.marks]
                values = [s.charset, s.ends, s.last_end, s.utf8, s.head, s.tail, pairs]
                own = [row.column(row.schema.get_field_index(c)) for c in keep]
                names = [*keep, "charset", "ends", "last_end", "utf8", "head", "tail", "marks"]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array([v], k) for v, k in zip(values, kinds, strict=True)]], names)

    # Ranges of one large file are many tasks.
    tasks = files.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(tasks, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path", "part").mapInArrow(scan, schema)


def index_files(
    files: DataFrame,
    charset: str | None = None,
    every: int = EVERY_LINES,
    span_bytes: int = SPAN_BYTES,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """``path, line, lines, offset, end, charset, n_lines, size, modified``: the spans of files ``path, size, modified``.

    ``line`` is the number of the lines before the span, ``end`` the first byte behind it.  A file
    without bytes has one span without lines.
    """
    ship_package(files.sparkSession)
    named = charset_name(charset) if charset else None
    parts = materialize(_ranges(files, range_bytes, named, every, span_bytes), "line_ranges")
    order = Window.partitionBy("path").orderBy("part")
    before = F.coalesce(F.sum("ends").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A character on the edge of two ranges: what the one has too little and the other too much.
    edge = F.is_valid_utf8(F.concat(F.coalesce(F.lag("tail").over(order), F.lit(b"")), "head").cast("string"))
    rest = F.lead("part").over(order).isNull() & (F.octet_length("tail") > 0)
    based = parts.withColumns({"base": before, "utf8": F.col("utf8") & edge & ~rest})
    totals = based.groupBy("path").agg(
        F.sum("ends").alias("ends"), F.max("last_end").alias("last_end"), F.every("utf8").alias("utf8"),
        F.first("charset").alias("told"), F.first("size").alias("size"), F.first("modified").alias("modified"),
    )
    guessed = F.when(F.col("utf8"), "UTF-8").otherwise("GB18030")
    totals = totals.select(
        "path", "size", "modified", F.coalesce("told", guessed).alias("charset"),
        (F.col("ends") + (F.col("size") > F.col("last_end")).cast("long")).alias("n_lines"),
    )
    marks = based.select("path", "base", F.explode("marks").alias("m")).select("path", (F.col("base") + F.col("m.n")).alias("line"), F.col("m.offset").alias("offset"))
    starts = totals.select("path", F.lit(0).cast("long").alias("line"), F.lit(0).cast("long").alias("offset"))
    spans = marks.unionByName(starts).join(totals, "path").where("offset < size OR offset = 0")
    following = Window.partitionBy("path").orderBy("line")
    spans = spans.withColumns({
        "lines": F.coalesce(F.lead("line").over(following), F.col("n_lines")) - F.col("line"),
        "end": F.coalesce(F.lead("offset").over(following), F.col("size")),
    })
    return spans.select(*_INDEX)


def index_lines(spark: SparkSession, paths, folder: str | None = None, **options) -> DataFrame:
    """The stored index of all files below some paths, sorted so that a read prunes the files it skips."""
    index = index_files(listing(spark, [paths] if isinstance(paths, str) else paths), **options)
    ordered = index.repartitionByRange("path", "line").sortWithinPartitions("path", "line")
    if folder is None:
        return materialize(ordered, "line_index")
    ordered.write.mode("overwrite").parquet(folder)
    return spark.read.schema(index.schema).parquet(folder)


def changed_files(index: DataFrame, files: DataFrame) -> DataFrame:
    """Paths that are new, gone, or of another size or time than when they were indexed."""
    known = index.where("line = 0").select("path", "size", "modified", F.lit(True).alias("_known"))
    now = files.select("path", F.col("size").alias("_size"), F.col("modified").alias("_modified"), F.lit(True).alias("_now"))
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("modified").eqNullSafe(F.col("_modified"))
    return known.join(now, "path", "full").where(F.col("_known").isNull() | F.col("_now").isNull() | ~same).select("path")


def span_lines(path: str, offset: int, end: int, charset: str, skip: int, count: int) -> Iterator[tuple[int, bytes, int]]:
    """``(place in the span, bytes, length with the line end)`` of ``count`` lines of a span after the first ``skip``.

    Nothing beyond the last of them, and nothing outside the span, is read.
    """
    width = 2 if charset.startswith("UTF-16") else 1
    with opened(path) as data:
        if data.size() < end:
            raise ValueError(f"{path} is shorter than when it was indexed")
        data.seek(offset)
        at, number, rest = offset, 0, []
        while number < skip + count and at < end:
            piece = data.read(min(SPAN_BYTES, end - at))
            at += len(piece)
            begin = 0
            for stop in line_ends(piece, charset).tolist():
                line = b"".join([*rest, piece[begin:stop]])
                if skip <= number < skip + count:
                    yield number, line[:-width], len(line)
                number, begin, rest = number + 1, stop, []
            rest.append(piece[begin:])
        if number < skip + count and (line := b"".join(rest)):
            yield number, line, len(line)


def read_spans(spans: DataFrame) -> DataFrame:
    """``path, line_no, raw, raw_len, charset`` of spans ``path, line, offset, end, charset, skip, take``."""
    ship_package(spans.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "line_no", "raw", "raw_len", "charset"]
        for batch in batches:
            for path, line, offset, end, charset, skip, take in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows: list[tuple] = []

                def rows_batch() -> pa.RecordBatch:
                    numbers, raw, sizes = zip(*rows, strict=True)
                    columns = [pa.array([path] * len(rows)), pa.array([line + n + 1 for n in numbers], pa.int64()), pa.array(raw, pa.binary()), pa.array(sizes, pa.int64()), pa.array([charset] * len(rows))]
                    return pa.RecordBatch.from_arrays(columns, names)

                held = 0
                for row in span_lines(path, offset, end, charset, skip, take):
                    rows.append(row)
                    held += row[2]
                    if len(rows) >= BATCH_LINES or held >= SPAN_BYTES:
                        yield rows_batch()
                        rows, held = [], 0
                if rows:
                    yield rows_batch()

    wanted = spans.select("path", "line", "offset", "end", "charset", "skip", "take")
    return wanted.mapInArrow(read, "path string, line_no long, raw binary, raw_len long, charset string")


def range_spans(index: DataFrame, start: int, count: int, path: str | None = None) -> DataFrame:
    """The spans that hold lines ``start + 1`` to ``start + count`` of one file, or of every file."""
    held = index.where((F.col("line") < start + count) & (F.col("line") + F.col("lines") > start))
    held = held if path is None else held.where(F.col("path") == path)
    skip = F.greatest(F.lit(start) - F.col("line"), F.lit(0))
    return held.withColumns({"skip": skip, "take": F.least(F.col("lines"), F.lit(start + count) - F.col("line")) - skip})


def indexed_range(index: DataFrame, start: int, count: int, path: str | None = None, limit: int | None = None) -> DataFrame:
    """``path, line_no, raw_len, content, truncated`` of a range of lines, of one file or of every file.

    Beyond the last line there is nothing; ``limit`` cuts lines to so many bytes.
    """
    return _finished(read_spans(range_spans(index, start, count, path)), limit)


def indexed_lines(index: DataFrame, limit: int | None = None) -> DataFrame:
    """``path, line_no, raw_len, content, truncated`` of all lines of all files, of any size and charset."""
    return _finished(read_spans(index.withColumns({"skip": F.lit(0).cast("long"), "take": F.col("lines")})), limit)


def _finished(raw: DataFrame, limit: int | None) -> DataFrame:
    return finish_lines(raw, F.col("charset"), limit).select("path", "line_no", "raw_len", "content", "truncated")
