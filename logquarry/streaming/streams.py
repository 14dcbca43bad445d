"""Structured Streaming jobs over file events, arrivals, journals and lines.

A job is a source, a batch operator from ``logquarry.operators`` and a table that
is safe to replay, so a stream gives the same answer as its batch operator.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logquarry.functions.classify import passes_filter
from logquarry.functions.paths import comparable
from logquarry.operators.changes import (
    is_degraded,
    last_per_key,
    normalize_arrivals,
    normalize_directory_events,
)
from logquarry.operators.lines import finish_lines, number_blocks
from logquarry.operators.roots import is_covered, without_excluded
from logquarry.operators.search import search
from logquarry.operators.stability import arrivals
from logquarry.operators.trees import DIR_CACHE, tree_delta
from logquarry.sources.files import plain_path
from logquarry.streaming.tables import BatchTable

# Events are gathered this long before they are treated as one batch.
COALESCE = "200 milliseconds"
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def event_stream(
    spark: SparkSession,
    path: str,
    schema,
    roots: Sequence[str] | None = None,
    exclusions: Sequence[str] = (),
    max_files: int = 100,
    fmt: str = "parquet",
) -> DataFrame:
    """File events under the roots and outside the exclusions."""
    events = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).load(path)
    if roots is not None:
        events = is_covered(events, list(roots)).where("covered").drop("covered")
    return without_excluded(events, list(exclusions)) if exclusions else events


def new_files(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    """Files appearing under a root; only their metadata is selected."""
    found = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(root)
    )
    return found.select(plain_path(F.col("path")).alias("path"), F.col("length").alias("size"))


def run(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Start a job that hands each coalesced batch to ``handle``.

    A handler looks at its batch several times, so the batch is kept meanwhile;
    an executor that is lost takes nothing along that its files cannot give back.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            handle(batch, batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=COALESCE)
    return writer.start()


def finish(query: StreamingQuery) -> None:
    """Wait for a bounded run and pass its failure on."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def directory_changes(out: BatchTable) -> Callable[[DataFrame, int], None]:
    """Handler: normalised changes of each batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        out.write(normalize_directory_events(batch), batch_id)

    return handle


def arrival_words(out: BatchTable, metrics: BatchTable) -> Callable[[DataFrame, int], None]:
    """Handler: schedule and cancel sets, and whether the batch was lossy."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        out.write(normalize_arrivals(batch), batch_id)
        metrics.write(is_degraded(batch), batch_id)

    return handle


def stable_arrivals(out: BatchTable, waiting: BatchTable) -> Callable[[DataFrame, int], None]:
    """Handler: announce files whose size has settled.

    ``waiting`` keeps the events of open waits, at most 22 per path, from one
    batch to the next; replaying a batch starts from the one before it.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        known = waiting.previous(batch_id)
        done, still = arrivals(known.unionByName(batch.select(*known.columns)))
        out.write(done, batch_id)
        waiting.write(still, batch_id)

    return handle


def dirty_roots(out: BatchTable) -> Callable[[DataFrame, int], None]:
    """Handler: scopes whose events were lost and must be rebuilt."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        lost = batch.where(F.col("op") == "overflow").select("watch_dir").distinct()
        out.write(lost, batch_id)

    return handle


NODE_LOG = "id bigint, parent_id bigint, name string, attributes int, seq bigint, gone boolean"
FILE_LOG = "id bigint, path string, gone boolean"
DIR_LOG = f"{DIR_CACHE}, gone boolean"


def live_nodes(log: BatchTable, before: int | None = None) -> DataFrame:
    """Nodes after all batches of a node log, or after those before one batch."""
    rows = last_per_key(log.read(before).drop("batch_id"), ["id"])
    return rows.where(~F.col("gone")).drop("gone")


def live_files(log: BatchTable, before: int | None = None) -> DataFrame:
    """Files after all batches of a file log: the newest batch of an id wins."""
    rows = last_per_key(log.read(before), ["id"], "batch_id")
    return rows.where(~F.col("gone")).select("id", "path")


def journal_updates(
    nodes: BatchTable, dirs: BatchTable, files: BatchTable, root: str, exclusions: Sequence[str] = ()
) -> Callable[[DataFrame, int], None]:
    """Handler: keep nodes, the directory cache and files current from journal records.

    Only what a batch touches is resolved and written.  A batch starts from the
    state of the batches before it, so replaying it writes the same rows again.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        for table in (nodes, dirs):
            table.fold(["id"], batch_id)
        before, cache = (t.state(["id"], batch_id).where(~F.col("gone")).drop("gone") for t in (nodes, dirs))
        node_rows, dir_rows, file_rows = tree_delta(before, cache, batch, root, list(exclusions))
        files.write(file_rows, batch_id)
        dirs.write(dir_rows, batch_id)
        nodes.write(node_rows, batch_id)

    return handle


def catalog_feed(out: BatchTable, derive: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Handler: derived search rows of each batch of changed catalog rows.

    The newest batch of a path wins when the table is read.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        out.write(derive(last_per_key(batch, ["path"])), batch_id)

    return handle


# --- unread notifications ---------------------------------------------------


def unread_facts(events: DataFrame) -> DataFrame:
    """What decides about a path: first and last arrival, first read, last end.

    Works on streams and on tables; every fact is a minimum or a maximum, so it
    is combined before the shuffle and updated in place by a state store.
    ``events`` holds ``seq, path, op`` with op arrive, read or remove.
    """
    op, seq = F.col("op"), F.col("seq")
    return events.groupBy("path").agg(
        F.min(F.when(op == "arrive", seq)).alias("first_arrival"),
        F.max(F.when(op == "arrive", seq)).alias("last_arrival"),
        F.min(F.when(op == "read", seq)).alias("first_read"),
        F.max(F.when(op.isin("read", "remove"), seq)).alias("last_end"),
    )


FACTS = "path string, first_arrival bigint, last_arrival bigint, first_read bigint, last_end bigint"


def unread(facts: DataFrame, all_read_at: int | None = None, repeat: bool = False) -> DataFrame:
    """Unread paths ``path, seq``.

    A path seen once is never unread again; with ``repeat`` a newer arrival of
    the same path counts again.  ``all_read_at`` is when everything was read.
    """
    end = F.greatest(F.col("last_end"), F.lit(all_read_at).cast("bigint"))
    if repeat:
        shown = F.col("last_arrival").isNotNull() & (end.isNull() | (end < F.col("last_arrival")))
        return facts.where(shown).select("path", F.col("last_arrival").alias("seq"))
    unseen = F.col("first_read").isNull() | (F.col("first_read") > F.col("first_arrival"))
    shown = F.col("first_arrival").isNotNull() & unseen & (end.isNull() | (end < F.col("first_arrival")))
    return facts.where(shown).select("path", F.col("first_arrival").alias("seq"))


def unread_stream(events: DataFrame, out: BatchTable, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Keep the facts of every path in Spark's state store, changes in ``out``."""
    writer = (
        unread_facts(events)
        .writeStream.outputMode("update")
        .foreachBatch(lambda batch, batch_id: out.write(batch, batch_id))
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=COALESCE)).start()


def newest_first() -> list[Column]:
    """Order of the unread list."""
    return [-F.col("seq"), F.col("path")]


def notifications(
    detected: DataFrame, roots: Sequence[str], suffixes: Sequence[str], show_all: bool = False
) -> DataFrame:
    """Detected files still under a root and passing the current filter, once each.

    ``detected`` holds ``seq, path, name, is_archive``; overlapping roots and
    spellings of one path give one notification, the first.
    """
    covered = is_covered(detected, list(roots)).where("covered").drop("covered")
    wanted = covered.where(passes_filter(F.col("name"), F.col("is_archive"), suffixes, show_all))
    first = wanted.groupBy(comparable(F.col("path")).alias("key")).agg(
        F.min_by(F.struct("seq", "path", "name"), "seq").alias("d")
    )
    return first.select("d.*")


# --- partial results and growing line tables --------------------------------


def partial_search(snapshot: DataFrame, arriving: DataFrame, query: str, ready: bool, **options):
    """Search the last snapshot together with rows that arrived since."""
    newer = arriving.select(*snapshot.columns)
    both = snapshot.join(newer.select("path"), "path", "left_anti").unionByName(newer)
    return search(both, query, partial=not ready, **options)


LINES = "path string, line_no bigint, raw_len bigint, content string, truncated boolean"


def line_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Raw lines of files appearing under a folder."""
    text = (
        spark.readStream.format("text")
        .option("lineSep", "\n")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(path)
    )
    raw = F.col("value").cast("binary")
    return text.select(
        plain_path(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        raw.alias("raw"),
        (F.octet_length(raw) + 1).cast("bigint").alias("raw_len"),
    )


def publish_lines(out: BatchTable) -> Callable[[DataFrame, int], None]:
    """Handler: number the lines of each batch of files and publish them.

    A file belongs to one batch, so its lines appear together and complete.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        raw = batch.withColumn("row_id", F.monotonically_increasing_id())
        out.write(finish_lines(number_blocks(raw)), batch_id)

    return handle
