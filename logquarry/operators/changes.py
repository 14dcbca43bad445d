"""Change records and events reduced, merged and applied.

Every reduction is "the last record of a key wins", written as ``max_by`` over a
sequence number: it is combined before the shuffle, so one busy key costs no
more than a quiet one, and replaying a batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.constants import MAX_JOURNAL_REPLAY, REASON_DELETE, REASON_RENAME_OLD
from logquarry.functions.classify import has_bits
from logquarry.functions.paths import comparable, parent_dir
from logquarry.operators.nodes import affected_files, is_directory, latest_records, resolve_files
from logquarry.operators.roots import root_matches, without_excluded
from logquarry.plans.skew import lookup_join
from logquarry.session import materialize, materialize_counting


def last_per_key(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_row")).select(*keys, "_row.*")


# --- catalog merges ---------------------------------------------------------


def upsert(catalog: DataFrame, rows: DataFrame, key: str = "path") -> DataFrame:
    """Catalog with ``rows`` replacing or joining it by key."""
    return catalog.join(rows.select(key), key, "left_anti").unionByName(rows.select(*catalog.columns))


def insert_absent(catalog: DataFrame, rows: DataFrame, key: str = "path") -> DataFrame:
    """Catalog with those ``rows`` whose key it does not hold yet."""
    return catalog.unionByName(rows.join(catalog.select(key), key, "left_anti").select(*catalog.columns))


def delete_keys(catalog: DataFrame, keys: DataFrame, key: str = "path") -> DataFrame:
    """Catalog without the given keys."""
    return catalog.join(keys.select(key), key, "left_anti")


def changed_rows(feed: DataFrame, catalog: DataFrame) -> DataFrame:
    """Current catalog rows of the paths whose last change is an upsert (op 1)."""
    wanted = last_per_key(feed, ["path"]).where(F.col("op") == 1).select("path")
    return catalog.join(wanted, "path", "left_semi")


def maintain_search_columns(derived: DataFrame, feed: DataFrame, catalog: DataFrame, derive) -> DataFrame:
    """Delete every changed path from ``derived``, add the current rows again.

    ``derive`` turns catalog rows into rows of ``derived``.
    """
    touched = feed.select("path").distinct()
    fresh = derive(changed_rows(feed, catalog))
    return derived.join(touched, "path", "left_anti").unionByName(fresh.select(*derived.columns))


# --- directory events -------------------------------------------------------


def normalize_directory_events(events: DataFrame) -> DataFrame:
    """One pending change per path, or one rescan per directory.

    Input ``seq, watch_dir, op, path, old_path, present``; output ``watch_dir,
    op, path, old_path`` with op upsert, remove, rename or rescan.  Access is
    ignored, so are paths not directly in the directory.  A rename drops what is
    pending for both of its paths and stands under a key of its own.  Unpaired
    renames, vanished targets and unspecific events make the directory rescan.
    """
    top = comparable(parent_dir(F.col("path"))) == comparable(F.col("watch_dir"))
    old_top = comparable(parent_dir(F.col("old_path"))) == comparable(F.col("watch_dir"))
    op, here = F.col("op"), F.col("present")
    lost = ~here & ((op == "modify") | ((op == "rename") & old_top))
    vague = (op == "rename_unpaired") | (op == "any")
    ambiguous = F.coalesce(
        (op == "overflow")
        | ((op == "any") & F.col("path").isNull())
        | ((lost | vague) & top)
        | ((op == "rename_unpaired") & old_top),
        F.lit(False),
    )

    def pending(key: Column, what: str, path: Column) -> Column:
        return F.struct(key.alias("key"), F.lit(what).alias("op"), path.alias("path"))

    steps = F.when(
        top,
        F.when(op.isin("create", "modify") & here, F.array(pending(F.col("path"), "upsert", F.col("path"))))
        .when(op == "remove", F.array(pending(F.col("path"), "remove", F.col("path"))))
        .when(
            (op == "rename") & here & old_top,
            F.array(
                pending(F.col("old_path"), "drop", F.col("path")),
                pending(F.col("path"), "drop", F.col("path")),
                pending(F.concat(F.lit("rename:"), F.col("old_path")), "rename", F.col("path")),
            ),
        ),
    )
    rescans = events.where(ambiguous).select("watch_dir").distinct()
    each = events.select("seq", "watch_dir", "old_path", F.inline(steps))
    last = last_per_key(each, ["watch_dir", "key"]).where(F.col("op") != "drop")
    kept = lookup_join(last, rescans, "watch_dir", "left_anti").select(
        "watch_dir", "op", "path", F.when(F.col("op") == "rename", F.col("old_path")).alias("old_path")
    )
    none = F.lit(None).cast("string")
    return kept.unionByName(
        rescans.select("watch_dir", F.lit("rescan").alias("op"), none.alias("path"), none.alias("old_path"))
    )


def apply_directory_changes(rows: DataFrame, changes: DataFrame, listing: DataFrame) -> DataFrame:
    """Apply normalised changes to directory rows ``watch_dir, path, children``.

    Changed directories are edited, rescanned ones replaced by ``listing``
    (``watch_dir, path``), others left alone.  Known children are kept.
    """
    rescans = changes.where(F.col("op") == "rescan").select("watch_dir").distinct()
    edits = changes.where(F.col("op") != "rescan")
    gone = (
        edits.where(F.col("op") == "remove").select("watch_dir", "path")
        .unionByName(edits.where(F.col("op") == "rename").select("watch_dir", F.col("old_path").alias("path")))
        .distinct()
    )
    incoming = edits.where(F.col("op").isin("upsert", "rename")).select("watch_dir", "path")
    keys = ["watch_dir", "path"]
    stay = lookup_join(rows, rescans, "watch_dir", "left_anti").select(*keys).join(gone, keys, "left_anti")
    listed = lookup_join(listing, rescans, "watch_dir", "left_semi").select(*keys)
    after = stay.unionByName(incoming).unionByName(listed).distinct()
    return keep_children(after, rows, keys)


def keep_children(after: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Rows after a change with the children known before it."""
    known = before.select(*keys, F.col("children"))
    return after.join(known, keys, "left")


def vanished(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows of ``before`` whose key is no longer there."""
    return before.join(after.select(key), key, "left_anti")


# --- arrivals ---------------------------------------------------------------


def normalize_arrivals(events: DataFrame) -> DataFrame:
    """Last word per path: ``path, action`` with action schedule or cancel.

    Input ``seq, op, path, old_path, present``.
    """
    op = F.col("op")

    def word(path: Column, action) -> Column:
        action = F.lit(action) if isinstance(action, str) else action
        return F.struct(path.alias("path"), action.alias("action"))

    by_presence = F.when(F.col("present"), F.lit("schedule")).otherwise(F.lit("cancel"))
    words = (
        F.when(op.isin("create", "data"), F.array(word(F.col("path"), "schedule")))
        .when(op.isin("remove", "rename_from"), F.array(word(F.col("path"), "cancel")))
        .when(
            op == "rename",
            F.array(word(F.col("old_path"), "cancel"), word(F.col("path"), "schedule")),
        )
        .when(op.isin("modify", "rename_unpaired", "any", "overflow"), F.array(word(F.col("path"), by_presence)))
    )
    each = events.select("seq", words.alias("w")).where(F.col("w").isNotNull()).select("seq", F.posexplode("w"))
    flat = each.select(F.col("col.path").alias("path"), F.col("col.action").alias("action"), F.struct("seq", "pos").alias("seq"))
    return last_per_key(flat.where(F.col("path").isNotNull()), ["path"]).select("path", "action")


def is_degraded(events: DataFrame) -> DataFrame:
    """One row: did the batch hold an unspecific or lossy event?"""
    lossy = F.col("op").isin("any", "overflow")
    return events.agg(F.coalesce(F.bool_or(lossy), F.lit(False)).alias("degraded"))


# --- catalog events ---------------------------------------------------------


def apply_path_events(
    catalog: DataFrame, events: DataFrame, listing: DataFrame, exclusions: list[str]
) -> DataFrame:
    """Catalog after a batch of bare path events.

    ``listing`` is what exists now (catalog columns).  A path that is a file is
    upserted, one that is a directory brings its whole subtree, one that is gone
    takes its subtree out of the catalog.
    """
    touched = materialize(without_excluded(events.select("path").distinct(), exclusions), "touched_paths")
    as_root = touched.select(F.col("path").alias("root"))
    current = without_excluded(listing, exclusions)
    fresh_paths = materialize(root_matches(current, "path", as_root), "touched_files")
    fresh = current.join(fresh_paths.select("path").distinct(), "path", "left_semi")
    alive = fresh_paths.select(F.col("root")).distinct()
    missing = as_root.join(alive, "root", "left_anti")
    gone = root_matches(catalog, "path", missing).select("path").distinct()
    return upsert(catalog.join(gone, "path", "left_anti"), fresh)


# --- journal ----------------------------------------------------------------


def resume_plan(state: DataFrame, info: DataFrame) -> DataFrame:
    """Per root: may the journal be resumed, and from where to where?

    ``state``: ``root, identity, journal_id, next_seq, complete``; ``info``:
    ``root, identity, journal_id, first_seq, next_seq``.
    """
    now = info.select(
        "root",
        F.col("identity").alias("_identity"),
        F.col("journal_id").alias("_journal_id"),
        F.col("first_seq").alias("_first"),
        F.col("next_seq").alias("_next"),
    )
    valid = (
        F.col("complete")
        & (F.col("identity") == F.col("_identity"))
        & (F.col("journal_id") == F.col("_journal_id"))
        & F.col("next_seq").between(F.col("_first"), F.col("_next"))
    )
    return now.join(state, "root", "left").select(
        "root",
        F.coalesce(valid, F.lit(False)).alias("resumable"),
        F.col("next_seq").alias("from_seq"),
        F.col("_next").alias("to_seq"),
    )


def catch_up_records(
    journal: DataFrame, plan: DataFrame, limit: int = MAX_JOURNAL_REPLAY
) -> tuple[DataFrame, DataFrame]:
    """Records to replay and the roots to rebuild instead.

    A root whose replay would exceed ``limit`` records is rebuilt as a whole, so
    no record is lost to the limit.
    """
    ready = plan.where("resumable").select("root", "from_seq", "to_seq")
    todo = lookup_join(journal, ready, "root").where(
        (F.col("seq") >= F.col("from_seq")) & (F.col("seq") < F.col("to_seq"))
    )
    over = todo.groupBy("root").count().where(F.col("count") > limit).select("root")
    rebuild = plan.where(~F.col("resumable")).select("root").unionByName(over)
    return lookup_join(todo, over, "root", "left_anti").select(*journal.columns), rebuild


def node_log(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """Nodes and the records that touch them as one log with a ``gone`` mark.

    Records of an old name are left out.
    """
    deleted = has_bits(F.col("reason"), REASON_DELETE)
    real = records.where(deleted | ~has_bits(F.col("reason"), REASON_RENAME_OLD))
    fields = ["id", "parent_id", "name", "attributes", "seq"]
    return nodes.select(*fields, F.lit(False).alias("gone")).unionByName(real.select(*fields, deleted.alias("gone")))


def apply_records(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """Nodes after journal records: delete, or replace.

    Records not newer than a node are ignored, so a replayed or overlapping
    batch is harmless.
    """
    return last_per_key(node_log(nodes, records), ["id"]).where(~F.col("gone")).drop("gone")


def changed_ids(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """``id, is_dir``: ids of the batch; a directory before or now counts as one."""
    now = records.groupBy("id").agg(F.bool_or(is_directory(F.col("attributes"))).alias("_now"))
    old = nodes.select("id", is_directory(F.col("attributes")).alias("_old"))
    return now.join(old, "id", "left").select(
        "id", (F.col("_now") | F.coalesce("_old", F.lit(False))).alias("is_dir")
    )


def journal_delta(
    nodes: DataFrame, records: DataFrame, root: str, exclusions: list[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """What one batch of records changes: node rows and file rows.

    Both carry ``gone``; a file is gone when it was affected before the batch and
    is not resolved anew after it.  ``nodes`` holds each id once.
    """
    total = {"n": F.count(F.lit(1))}
    new, seen = materialize_counting(apply_records(nodes, records), "journal_nodes", **total)
    changed, more = materialize_counting(changed_ids(nodes, records), "journal_changed", **total)
    # Nodes before the batch are at most those after it and those it deleted.
    bound = seen["n"] + more["n"]
    leaving = affected_files(nodes, changed, bound)
    entering = affected_files(new, changed, bound)
    paths = resolve_files(new, root).entries.select("id", "path")
    fresh = without_excluded(paths.join(entering, "id", "left_semi"), list(exclusions))
    fresh = materialize(fresh.select("id", "path"), "journal_files")
    left = leaving.join(fresh, "id", "left_anti").select("id", F.lit(None).cast("string").alias("path"))
    file_rows = fresh.withColumn("gone", F.lit(False)).unionByName(left.withColumn("gone", F.lit(True)))
    touched = last_per_key(node_log(nodes.limit(0), records), ["id"])
    return touched, file_rows


def apply_journal(
    nodes: DataFrame, files: DataFrame, records: DataFrame, root: str, exclusions: list[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """New nodes and new files ``id, path`` after one batch of journal records."""
    old = materialize(latest_records(nodes), "journal_old")
    _, file_rows = journal_delta(old, records, root, exclusions)
    kept = files.select("id", "path").join(file_rows, "id", "left_anti")
    return apply_records(old, records), kept.unionByName(file_rows.where(~F.col("gone")).select("id", "path"))


# --- revisions --------------------------------------------------------------


def revision(size: Column, modified: Column) -> Column:
    """``length:seconds:nanoseconds`` of a file, ``length:unknown`` without mtime."""
    micros = F.unix_micros(modified)
    known = F.concat_ws(
        ":",
        size.cast("string"),
        F.floor(micros / 1_000_000).cast("string"),
        ((micros % 1_000_000) * 1000).cast("string"),
    )
    return F.when(modified.isNotNull() & (micros >= 0), known).otherwise(F.concat(size.cast("string"), F.lit(":unknown")))


def epoch_millis(modified: Column) -> Column:
    """Milliseconds since the epoch, null before it."""
    millis = F.unix_millis(modified)
    return F.when(millis >= 0, millis)


def compare_revisions(known: DataFrame, current: DataFrame) -> DataFrame:
    """``path, change``: same, modified, deleted or first_seen.

    Both sides hold ``path, revision`` once per path.
    """
    old = known.select("path", F.col("revision").alias("_old"), F.lit(True).alias("_had"))
    new = current.select("path", F.col("revision").alias("_new"), F.lit(True).alias("_has"))
    both = old.join(new, "path", "full")
    return both.select(
        "path",
        F.when(F.col("_has").isNull(), F.lit("deleted"))
        .when(F.col("_had").isNull() | F.col("_old").isNull(), F.lit("first_seen"))
        .when(F.col("_new").isNotNull() & (F.col("_old") != F.col("_new")), F.lit("modified"))
        .otherwise(F.lit("same"))
        .alias("change"),
    )


def source_prompts(prompts: DataFrame) -> DataFrame:
    """One prompt per source: a deletion beats any modification, then the newest.

    Input ``path, kind, revision, seq``.
    """
    strength = F.when(F.col("kind") == "modified", 0).otherwise(1)
    best = F.max_by(F.struct("path", "kind", "revision"), F.struct(strength, F.col("seq")))
    return prompts.groupBy(comparable(F.col("path")).alias("source")).agg(best.alias("p")).select(
        "source", "p.kind", "p.revision"
    )
