"""Archives as entry tables and line tables.

One row per container goes in, naming the place where it is stored; the task
opens it there as a stream, so a container of any size passes through no table.
Arrow batches of entries or lines come out as they are decoded.  Small nested
containers are expanded by the task that meets them, up to a number of bytes for
each outer one.  All others are copied to the shared folder and expanded level
by level; each level is one map, and is spread over the tasks again, so one
container full of containers does not stay in one task.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator, Sequence
from contextlib import closing, nullcontext
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.constants import ARCHIVE_SUFFIXES, LOG_EXTENSIONS, SAMPLE_BYTES, ArchiveLimits
from logquarry.functions.classify import (
    detect_format,
    is_archive_name,
    is_log_name,
    is_safe_entry,
)
from logquarry.functions.paths import file_name
from logquarry.functions.text import decode_bytes, lenient_charsets, strip_bom, strip_line_end
from logquarry.operators.lines import line_pieces
from logquarry.session import materialize, ship_package, spread, spread_places, work_path
from logquarry.sources.decoders import (
    SECTION,
    Entry,
    OverLimit,
    Pack,
    entries_of,
    format_of,
    heads_of,
    is_regular_member,
    is_text,
    line_chunks,
    open_member,
    open_place,
    read_upto,
    sample_charset,
    zip_members,
)
from logquarry.sources.files import plain_path

# Python tasks hold a few batches of this size at once.
BATCH_BYTES = 4 * 1024 * 1024
OUT_ROWS, OUT_BYTES = 2_000, 2 * 1024 * 1024
HEAD_ROWS = 256
SUFFIXES = tuple(suffix for suffix, _ in ARCHIVE_SUFFIXES)
# Containers, or entries of one, that a task opens.
CONTAINERS_PER_TASK = 2_000
# A ZIP up to this size is read by one task, entry by entry.
WHOLE_BYTES = 1024 * 1024
# Nested containers that a task expands by itself: the largest, and all within one outer container.
HELD_BYTES, ROOM_BYTES = 1024 * 1024, 16 * 1024 * 1024

KEYS = "source_path string, chain array<string>, decoded bigint"
ENTRY_SCHEMA = f"{KEYS}, entry_path string, size bigint, regular boolean, encrypted boolean, text boolean, error string"
LINE_SCHEMA = f"{KEYS}, entry_path string, charset string, line_no bigint, raw binary, truncated boolean, error string"
# Behind an entry, or beside the lines, the place of a nested container that is left to the next level.
SURVEY_SCHEMA = f"{ENTRY_SCHEMA}, place string, total bigint"
NESTED_SCHEMA = f"{LINE_SCHEMA}, place string, total bigint"
#: What one task reads: an entry of a ZIP by its place in the file, or, without one, a whole container.
WORK_SCHEMA = f"{KEYS}, name string, format string, place string, entry_path string, size bigint, offset bigint, packed bigint, crc bigint, method bigint, error string"


def bound_batches(spark: SparkSession) -> None:
    """Ready a session for tasks that carry file contents in Arrow batches."""
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str(2**31 - 1))) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def read_containers(spark: SparkSession, paths) -> DataFrame:
    """``path, place`` of files to expand; only their metadata is read here."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    named = files.select(plain_path(F.col("path")).alias("path"))
    return spread(named.withColumn("place", F.col("path")), "path")


def stored(files: DataFrame, content: str = "content") -> DataFrame:
    """Rows with a column of bytes, these written to the shared folder and replaced by their ``place``."""
    bound_batches(files.sparkSession)
    folder = work_path(files.sparkSession, "containers")
    kept = [c for c in files.columns if c != content]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with closing(Pack(folder)) as pack:
            for batch in batches:
                column = batch.column(batch.schema.get_field_index(content))
                places = [pack.save(io.BytesIO(data.as_py() or b""))[0] for data in column]
                columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(places, pa.string())], [*kept, "place"])

    schema = ", ".join(f"`{c}` {t}" for c, t in files.dtypes if c != content) + ", place string"
    return spread_places(materialize(files.mapInArrow(run, schema), "stored"), CONTAINERS_PER_TASK, "place")


def _with_heads(files: DataFrame) -> DataFrame:
    """Add ``head``, the first bytes of the file at ``place``, and ``_inner``, the first decompressed ones of a compressed stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, HEAD_ROWS):
                part = batch.slice(start, HEAD_ROWS)
                places = part.column(part.schema.get_field_index("place"))
                heads, inner = zip(*[heads_of(place.as_py(), SAMPLE_BYTES) for place in places])
                names = [*part.schema.names, "head", "_inner"]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(heads, pa.binary()), pa.array(inner, pa.binary())], names)

    schema = ", ".join(f"`{c}` {t}" for c, t in files.dtypes) + ", head binary, _inner binary"
    return files.mapInArrow(run, schema)


def with_format(files: DataFrame, name: Column | None = None) -> DataFrame:
    """Add ``head``, the first bytes of the file at ``place``, and ``format`` by what they are."""
    bound_batches(files.sparkSession)
    name = file_name(F.col("path")) if name is None else name
    lead = F.substring(F.col("head"), 1, 512)
    return _with_heads(files).withColumn("format", detect_format(lead, name, F.col("_inner"))).drop("_inner")


def start_level(files: DataFrame) -> DataFrame:
    """Outermost containers as the first level of the expansion; the task that opens one sees what it is."""
    bound_batches(files.sparkSession)
    return files.select(
        F.col("path").alias("source_path"),
        F.array().cast("array<string>").alias("chain"),
        F.lit(0).cast("bigint").alias("decoded"),
        file_name(F.col("path")).alias("name"),
        "place",
    )


def _expand(level: DataFrame, schema: str, visit: Callable, names: list[str], folder: str | None = None) -> DataFrame:
    """Run ``visit(row) -> rows`` over containers, emitting bounded batches.

    With a ``folder`` it is ``visit(row, pack)``, and each task keeps streams in a pack there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, weight, types = [], 0, _arrow_types(names)
        with closing(Pack(folder)) if folder else nullcontext() as pack:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                    for out in visit(row, pack) if folder else visit(row):
                        pending.append(out)
                        weight += sum(len(v) for v in out if isinstance(v, (bytes, str)))
                        if len(pending) >= OUT_ROWS or weight >= OUT_BYTES:
                            yield _to_batch(pending, types)
                            pending, weight = [], 0
        if pending:
            yield _to_batch(pending, types)

    return level.mapInArrow(run, schema)


def _arrow_types(names: list[str]) -> pa.Schema:
    kinds = {
        "source_path": pa.string(), "chain": pa.list_(pa.string()), "decoded": pa.int64(),
        "entry_path": pa.string(), "size": pa.int64(), "regular": pa.bool_(), "encrypted": pa.bool_(),
        "text": pa.bool_(), "error": pa.string(), "charset": pa.string(), "line_no": pa.int64(),
        "raw": pa.binary(), "truncated": pa.bool_(), "place": pa.string(), "total": pa.int64(),
        "name": pa.string(), "format": pa.string(), "offset": pa.int64(), "packed": pa.int64(), "crc": pa.int64(), "method": pa.int64(),
    }
    return pa.schema([(name, kinds[name]) for name in names])


def _to_batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(col, type=field.type) for col, field in zip(columns, types)], schema=types
    )


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def entries(level: DataFrame, limits: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """Entry rows ``source_path, chain, entry_path, size, is_log, encrypted, is_archive, error``.

    Only regular entries with safe names are listed.  A container that cannot be
    read, or breaks a limit, gives one row with ``error`` and no entries.
    """

    def visit(row: dict) -> Iterator[tuple]:
        key = (row["source_path"], row["chain"], row["decoded"])
        try:
            fmt, text = _kind(row)
            listed = [
                (*key, entry.name, entry.size, entry.regular, entry.encrypted, text, None)
                for entry in entries_of(row["place"], fmt, row["name"], limits)
            ]
            yield from listed
        except Exception as error:
            yield (*key, None, None, None, None, None, str(error))

    return _entry_rows(_expand(level, ENTRY_SCHEMA, visit, _names(ENTRY_SCHEMA)), limits)


def _kind(row: dict) -> tuple[str, bool]:
    """Format of a container, and whether it is a plain file of text; what others hold is known by name."""
    fmt, head = format_of(row["place"], row["name"])
    if row["chain"] and fmt == "plain":
        raise ValueError("entry content is not an archive")
    return fmt, fmt == "plain" and is_text(head)


def _entry_rows(rows: DataFrame, limits: ArchiveLimits) -> DataFrame:
    """The public columns of listed entries; unsafe and special ones are left out."""
    safe = is_safe_entry(F.col("entry_path"), limits.max_path_bytes) & F.col("regular")
    return rows.where(F.col("error").isNotNull() | safe).select(
        "source_path",
        "chain",
        "decoded",
        "entry_path",
        "size",
        ((is_log_name(F.col("entry_path")) | F.col("text")) & ~F.col("encrypted")).alias("is_log"),
        "encrypted",
        (is_archive_name(F.col("entry_path")) & ~F.col("encrypted")).alias("is_archive"),
        "error",
    )


def _is_log_member(name: str, fmt: str, wanted: str | None) -> bool:
    """Is an entry read as lines: a log by its extension, or the one asked for among these?"""
    return (name.rsplit(".", 1)[-1].lower() in LOG_EXTENSIONS or fmt == "plain") and wanted in (None, name)


def line_work(level: DataFrame, limits: ArchiveLimits = ArchiveLimits(), name: str | None = None) -> DataFrame:
    """What there is to read, spread over the tasks: the log entries of ZIPs one by one, other containers whole.

    A ZIP's central directory tells where each entry lies, so a file of a thousand entries is a thousand
    rows.  A ZIP that cannot be listed gives a row with ``error``.
    """

    def visit(row: dict) -> Iterator[tuple]:
        key, listed = (row["source_path"], row["chain"], row["decoded"], row["name"]), []
        fmt = None
        try:
            fmt, _ = _kind(row)
            if fmt != "zip":
                yield (*key, fmt, row["place"], *[None] * 7)
                return
            with open_place(row["place"]) as file:
                for info in zip_members(file, limits):
                    if is_regular_member(info) and not info.flag_bits & 1 and _is_log_member(info.filename, "zip", name):
                        listed.append((*key, fmt, row["place"], info.filename, info.file_size, info.header_offset, info.compress_size, info.CRC, info.compress_type, None))
            yield from listed
        except Exception as error:
            yield (*key, fmt, row["place"], *[None] * 6, str(error))

    rows = materialize(_expand(level, WORK_SCHEMA, visit, _names(WORK_SCHEMA)), "line_work")
    return spread_places(rows, CONTAINERS_PER_TASK, "place", "offset")


def _dealt(level: DataFrame) -> DataFrame:
    """Those containers whose entries are worth dealing: large ones, and files of unknown size."""
    size = F.regexp_extract("place", SECTION + r"\d+\+(\d+)$", 1)
    return level.where((size == "") | (size.cast("bigint") > WHOLE_BYTES))


def _is_dealt(place: str | bytes) -> bool:
    """The same of one place; a container that the task holds is none of them."""
    if isinstance(place, bytes):
        return False
    _, _, section = place.partition(SECTION)
    return not section or int(section.partition("+")[2]) > WHOLE_BYTES


def _chunks(key: tuple, name: str, source, left: int, most: int) -> Iterator[tuple]:
    """Rows of line chunks of one entry, at most ``left`` bytes of it."""
    head = source.read(SAMPLE_BYTES)
    charset = sample_charset(head)
    for number, size, raw, cut in line_chunks(source, charset, most, head, left):
        left -= size
        if left < 0:
            raise OverLimit
        yield (*key, name, charset, number, raw, cut, None)


def _container_lines(
    row: dict, fmt: str, limits: ArchiveLimits, most: int, name: str | None, inner: Callable | None = None, logs: bool = True
) -> Iterator[tuple]:
    """Line rows of a whole container, and one with ``error`` for what cannot be read.

    In a ZIP that stops no other entry; elsewhere no lines come after it.  ``inner`` is called with every
    entry, in order; then true is returned if all of them were seen.  Without ``logs`` it is all that happens.
    """
    key = (row["source_path"], row["chain"], row["decoded"])
    current, budget, meeting = None, limits.max_decoded_bytes - row["decoded"], False

    def failed(error: Exception) -> tuple:
        return (*key, current, None, None, None, None, str(error))

    try:
        for entry in entries_of(row["place"], fmt, row["name"], limits):
            # A ZIP that cannot be read further is no fault of its last entry.
            current = None if fmt == "zip" else entry.name
            if inner:
                meeting = True
                inner(entry)
                meeting = False
            if not logs or not entry.regular or entry.encrypted or not _is_log_member(entry.name, fmt, name):
                continue
            try:
                if fmt not in ("gz", "bz2", "xz", "zst") and entry.size > budget:
                    raise OverLimit
                yield from _chunks(key, entry.name, entry.lines(), budget, most)
            except Exception as error:
                current = entry.name
                yield failed(error)
                if fmt == "zip":
                    continue
                logs = False
                if not inner or not isinstance(error, OverLimit):
                    return False
    except Exception as error:
        if logs or meeting:
            yield failed(error)
        return False
    return True


def entry_lines(
    level: DataFrame, limits: ArchiveLimits = ArchiveLimits(), limit: int | None = None, name: str | None = None
) -> DataFrame:
    """Numbered lines of every log entry, or of those called ``name``, decoded by the entry's own charset.

    Entries of one large ZIP are read by many tasks, each at its own place in the file; an
    entry that cannot be read gives a row with ``error`` and stops no other.
    Python only decompresses and cuts the bytes at line ends; chunks of lines
    leave the task while the entry is still being read, and decoding, splitting
    and trimming are Columns.  ``limit`` cuts lines to so many bytes.
    """
    most = 2**31 - 1 if limit is None else limit

    def whole(row: dict) -> Iterator[tuple]:
        if _is_dealt(row["place"]):
            return
        try:
            fmt, _ = _kind(row)
        except Exception as error:
            yield (row["source_path"], row["chain"], row["decoded"], *[None] * 5, str(error))
            return
        yield from _container_lines(row, fmt, limits, most, name)

    raw = _expand(level, LINE_SCHEMA, whole, _names(LINE_SCHEMA))
    dealt = _dealt(level)
    if not dealt.isEmpty():
        raw = raw.unionByName(_dealt_lines(dealt, limits, most, name))
    return _shown_lines(raw, limits)


def _dealt_lines(level: DataFrame, limits: ArchiveLimits, most: int, name: str | None, zips_only: bool = False) -> DataFrame:
    """Line chunks of containers whose ZIPs are dealt entry by entry."""

    def visit(row: dict) -> Iterator[tuple]:
        key = (row["source_path"], row["chain"], row["decoded"])
        try:
            if row["error"] is not None:
                raise ValueError(row["error"])
            if row["offset"] is None:
                yield from _container_lines(row, row["format"], limits, most, name)
                return
            budget = limits.max_decoded_bytes - row["decoded"]
            if row["size"] > budget:
                raise OverLimit
            with open_place(row["place"]) as file:
                member = open_member(file, row["entry_path"], row["offset"], row["packed"], row["size"], row["crc"], row["method"])
                yield from _chunks(key, row["entry_path"], member, budget, most)
        except Exception as error:
            yield (*key, row["entry_path"], None, None, None, None, str(error))

    work = line_work(level, limits, name)
    return _expand(work.where("format = 'zip'") if zips_only else work, LINE_SCHEMA, visit, _names(LINE_SCHEMA))


def _shown_lines(raw: DataFrame, limits: ArchiveLimits) -> DataFrame:
    """Line chunks decoded, split and numbered."""
    safe = raw.where(F.col("error").isNotNull() | is_safe_entry(F.col("entry_path"), limits.max_path_bytes))
    with lenient_charsets(raw.sparkSession):
        text = safe.withColumn("text", decode_bytes(F.col("raw"), F.col("charset"))).drop("raw")
    # A failed row has no text and stays one row without a line.
    lines = F.when(F.col("error").isNull(), line_pieces(F.col("text")))
    fields = ["source_path", "chain", "decoded", "entry_path", "charset", "truncated", "error"]
    exploded = text.select(*fields, F.col("line_no").alias("_first"), F.posexplode_outer(lines).alias("_pos", "_line"))
    number = F.col("_first") + F.col("_pos")
    shown = F.when(number == 1, strip_bom(F.col("_line"))).otherwise(F.col("_line"))
    return exploded.select(*fields, number.alias("line_no"), strip_line_end(shown).alias("content"))


def is_safe_name(name: str, most: int) -> bool:
    """One entry name by the rule of the column ``is_safe_entry``."""
    parts = name.replace("\\", "/").split("/")
    return (
        0 < len(name.encode("utf-8", "replace")) <= most and "\0" not in name and name[0] not in "/\\" and "::" not in name
        and not any(part == ".." or ":" in part for part in parts)
    )


class Inner:
    """Containers met within one: small ones are held for this task, others are copied for the next level.

    ``room`` is what is left of the bytes that all containers within one outer container may hold.
    """

    def __init__(self, row: dict, fmt: str, limits: ArchiveLimits, pack: Pack, room: list[int], only: str | None):
        self.row, self.fmt, self.limits, self.pack, self.room, self.only = row, fmt, limits, pack, room, only
        self.held, self.left, self.failed = [], [], []

    def meet(self, entry: Entry) -> tuple[str | None, int | None]:
        """Take an entry that is a container by name; place and running size of one left to the next level."""
        holds = self.fmt != "plain" and entry.name.lower().endswith(SUFFIXES)
        if not holds or not entry.regular or entry.encrypted or self.only not in (None, entry.name):
            return None, None
        chain, decoded = [*self.row["chain"], entry.name], self.row["decoded"]
        source, budget = entry.open(), self.limits.max_decoded_bytes - decoded
        most = min(HELD_BYTES, self.room[0])
        data = place = read_upto(source, most + 1)
        size = len(data)
        if size > most:
            place, size = self.pack.save(source, budget, data) or (None, budget + 1)
        if size > budget:
            self.failed.append((chain, decoded, "decoded size limit exceeded"))
            return None, None
        if not is_safe_name(entry.name, self.limits.max_path_bytes):
            return None, None
        if len(chain) > self.limits.max_nested_depth:
            self.failed.append((chain, None, "nested too deep"))
            return None, None
        if isinstance(place, str):
            self.left.append((entry.name, place, decoded + size))
            return place, decoded + size
        self.room[0] -= size
        name = re.split(r"[/\\]", entry.name)[-1]
        self.held.append({"source_path": self.row["source_path"], "chain": chain, "decoded": decoded + size, "name": name, "place": data})
        return None, None


def _survey(limits: ArchiveLimits, room_bytes: int) -> Callable:
    """Visit that lists a container and the small ones within; one that cannot be read gives a row with ``error`` and no entries."""

    def visit(row: dict, pack: Pack, room: list[int] | None = None) -> Iterator[tuple]:
        key, room = (row["source_path"], row["chain"], row["decoded"]), [room_bytes] if room is None else room
        try:
            fmt, text = _kind(row)
            inner, listed = Inner(row, fmt, limits, pack, room, None), []
            for entry in entries_of(row["place"], fmt, row["name"], limits):
                place, total = inner.meet(entry)
                listed.append((*key, entry.name, entry.size, entry.regular, entry.encrypted, text, None, place, total))
        except Exception as error:
            yield (*key, *[None] * 5, str(error), None, None)
            return
        yield from listed
        for chain, decoded, error in inner.failed:
            yield (row["source_path"], chain, decoded, *[None] * 5, error, None, None)
        for held in inner.held:
            yield from visit(held, pack, room)

    return visit


def _line_survey(limits: ArchiveLimits, most: int, route: Sequence[str] | None) -> Callable:
    """Visit that gives the lines of a container and of the small ones within, or of the one entry at the end of a ``route``."""

    def visit(row: dict, pack: Pack, room: list[int] | None = None) -> Iterator[tuple]:
        source, depth, room = row["source_path"], len(row["chain"]), [ROOM_BYTES] if room is None else room
        last = route is not None and depth == len(route) - 1
        try:
            fmt, _ = _kind(row)
        except Exception as error:
            if route is None:
                yield (source, row["chain"], row["decoded"], *[None] * 5, str(error), None, None)
            return
        inner = None if last else Inner(row, fmt, limits, pack, room, route[depth] if route else None)
        logs = (route is None or last) and not (fmt == "zip" and _is_dealt(row["place"]))
        lines = _container_lines(row, fmt, limits, most, route[-1] if last else None, inner and inner.meet, logs)
        whole = yield from _widened(lines)
        if not whole or inner is None:
            return
        if route is None:
            for chain, decoded, error in inner.failed:
                yield (source, chain, decoded, *[None] * 5, error, None, None)
        for name, place, total in inner.left:
            yield (source, row["chain"], row["decoded"], name, *[None] * 5, place, total)
        for held in inner.held:
            yield from visit(held, pack, room)

    return visit


def _widened(lines: Iterator[tuple]) -> Iterator[tuple]:
    """Line rows without a nested place; what the iterator returns is returned."""
    while True:
        try:
            yield (*next(lines), None, None)
        except StopIteration as end:
            return end.value


def _levels(files: DataFrame, limits: ArchiveLimits, schema: str, visit: Callable) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels of containers below ``files`` that tasks left to the next one, and what ``visit`` gives of each, written."""
    level, levels, found = start_level(files), [], []
    while True:
        rows = materialize(_expand(level, schema, visit, _names(schema), work_path(level.sparkSession, "inner")), f"level_{len(levels) + 1}")
        levels.append(level)
        found.append(rows)
        inner = rows.where(F.col("place").isNotNull())
        if inner.isEmpty():
            return levels, found
        chained = inner.select(
            "source_path",
            F.concat("chain", F.array("entry_path")).alias("chain"),
            F.col("total").alias("decoded"),
            file_name(F.col("entry_path")).alias("name"),
            "place",
        )
        level = spread_places(chained, CONTAINERS_PER_TASK, "place")


def expand_nested(files: DataFrame, limits: ArchiveLimits = ArchiveLimits()) -> tuple[list[DataFrame], DataFrame]:
    """All levels of containers below ``files``, each stored, and the rows that failed.

    Containers deeper than the limit are reported, not opened.
    """
    levels, found = _levels(files, limits, SURVEY_SCHEMA, _survey(limits, 0))
    failed = [rows.where(F.col("error").isNotNull()).select("source_path", "chain", "error") for rows in found]
    return levels, reduce(DataFrame.unionByName, failed)


def all_entries(files: DataFrame, limits: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """Entries of every level; ``chain`` tells the containers on the way."""
    _, found = _levels(files, limits, SURVEY_SCHEMA, _survey(limits, ROOM_BYTES))
    return _entry_rows(reduce(DataFrame.unionByName, found), limits)


def nested_lines(files: DataFrame, limits: ArchiveLimits = ArchiveLimits(), limit: int | None = None) -> DataFrame:
    """Lines of the log entries of every level, and a row with ``error`` for each container that has none to give.

    That is one that cannot be read, is no archive in spite of its name, is nested too deep or breaks a limit.
    """
    return _nested_lines(files, limits, limit, None)


def _nested_lines(files: DataFrame, limits: ArchiveLimits, limit: int | None, route: Sequence[str] | None) -> DataFrame:
    most = 2**31 - 1 if limit is None else limit
    levels, found = _levels(files, limits, NESTED_SCHEMA, _line_survey(limits, most, route))
    raw = [rows.where(F.col("place").isNull()).drop("place", "total") for rows in found]
    for depth, level in enumerate(levels):
        # Entries of large ZIPs, which the visit left to many tasks.
        dealt = _dealt(level)
        if (route is None or depth == len(route) - 1) and not dealt.isEmpty():
            raw.append(_dealt_lines(dealt, limits, most, route[-1] if route else None, zips_only=True))
    return _shown_lines(reduce(DataFrame.unionByName, raw), limits)


def lines_of_entry(
    files: DataFrame, route: Sequence[str], limits: ArchiveLimits = ArchiveLimits(), limit: int | None = None
) -> DataFrame:
    """Lines of one entry of each file, reached through the containers that ``route`` names before it.

    Nothing else is copied or decoded; a file without the entry gives no line.
    """
    return _nested_lines(files, limits, limit, list(route))


def lookup_entries(requests: DataFrame, listed: DataFrame) -> DataFrame:
    """Requested entries with their rows; ``error`` says why one cannot be opened.

    Both sides hold ``source_path, entry_path``.  They are sorted and merged: what the planner
    knows of ``listed`` is the size of the containers' places, by which it would broadcast every entry.
    """
    found = listed.select("source_path", "entry_path", "size", "encrypted", "is_log", F.lit(True).alias("_found"))
    return requests.join(found.hint("merge"), ["source_path", "entry_path"], "left").select(
        "source_path",
        "entry_path",
        "size",
        F.when(F.col("_found").isNull(), F.lit("missing"))
        .when(F.col("encrypted"), F.lit("encrypted"))
        .when(~F.col("is_log"), F.lit("not a log"))
        .alias("error"),
    )


def entry_counts(listed: DataFrame, max_entries: int) -> DataFrame:
    """Entries per container and whether the limit holds."""
    counts = listed.where(F.col("error").isNull()).groupBy("source_path", "chain").agg(F.count(F.lit(1)).alias("n_entries"))
    return counts.withColumn("within_limit", F.col("n_entries") <= max_entries)


def browsable(listed: DataFrame) -> DataFrame:
    """Entries shown when browsing: logs and archives."""
    return listed.where(F.col("is_log") | F.col("is_archive"))
