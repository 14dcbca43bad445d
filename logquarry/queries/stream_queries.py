"""Streaming jobs, each run to its end over the whole table and read back.

The table is written in three parts, one after another, and the job is started
again from its checkpoint after each part, so every job here also shows that it
goes on where it stopped.
"""

from pyspark.sql import functions as F

from logquarry.functions.text import name_tokens
from logquarry.operators import changes as H
from logquarry.operators import stability
from logquarry.plans import views
from logquarry.queries import duck as D
from logquarry.queries.registry import query
from logquarry.queries.source_queries import (
    FILE_ROWS,
    JOURNAL_STATE,
    _bucketed,
    journal_positions,
    journal_with_root,
    written_lines,
)
from logquarry.session import materialize, work_path
from logquarry.sources.snapshots import Snapshots
from logquarry.streaming import streams as ST
from logquarry.streaming.tables import BatchTable

C = F.col
PARTS = 3


def play(spark, rows, name, start, seq="seq"):
    """Write ``rows`` part by part and run ``start(stream, checkpoint)`` after each."""
    source, checkpoint = work_path(spark, f"{name}_in"), work_path(spark, f"{name}_checkpoint")
    top = rows.agg(F.max(seq)).first()[0] or 0
    width = top // PARTS + 1
    for part in range(PARTS):
        now = rows.where((C(seq) >= part * width) & (C(seq) < (part + 1) * width))
        now.write.mode("append").parquet(source)
        stream = ST.event_stream(spark, source, rows.schema, max_files=1_000_000)
        ST.finish(start(stream, checkpoint))


def play_batches(spark, rows, name, handle, seq="seq"):
    """``play`` a job made of a batch handler."""
    play(spark, rows, name, lambda stream, checkpoint: ST.run(stream, handle, checkpoint, True), seq)


def _table(spark, name, schema, first=None):
    return BatchTable(spark, work_path(spark, name), schema, first)


# The parts of ``play`` in SQL.
PART = "CAST(seq // ((SELECT max(event_id) FROM events) // 3 + 1) AS BIGINT)"


# --- sources ----------------------------------------------------------------


@query("src_13_event_stream", rf"""WITH {D.FILE_EVENTS}
SELECT seq, op, path FROM file_events WHERE watch_dir IN ('/w/d1', '/w/d2', '/w/d3') AND NOT starts_with(path, '/w/d2/sub/')""")
def event_stream(spark, sf):
    rows = views.file_events(spark, sf)
    source = work_path(spark, "events_in")
    rows.write.parquet(source)
    out = _table(spark, "events_out", "seq bigint, op string, path string")
    stream = ST.event_stream(spark, source, rows.schema, ["/w/d1", "/w/d2", "/w/d3", "/w/d1/sub"], ["/w/d2/sub"])
    ST.finish(ST.run(stream, out.write, work_path(spark, "events_checkpoint"), True))
    return out.read().drop("batch_id")


@query("src_14_new_files", rf"""WITH {FILE_ROWS} SELECT bucket, true AS has_size FROM file_rows GROUP BY bucket""")
def new_files(spark, sf):
    out = _table(spark, "found", "path string, size bigint")
    stream = ST.new_files(spark, written_lines(spark, sf))
    ST.finish(ST.run(stream, out.write, work_path(spark, "found_checkpoint"), True))
    return _bucketed(out.read()).groupBy("bucket").agg((F.sum("size") > 0).alias("has_size"))


# --- event batches ----------------------------------------------------------


@query("sm_01_coalesced_batches", rf"""WITH {D.FILE_EVENTS}
SELECT {PART} AS batch_id, count(*) AS n_events, count(DISTINCT path) AS n_paths FROM file_events GROUP BY ALL""")
def coalesced_batches(spark, sf):
    out = _table(spark, "batches", "n_events bigint, n_paths bigint")

    def handle(batch, batch_id):
        out.write(batch.agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("path").alias("n_paths")), batch_id)

    play_batches(spark, views.file_events(spark, sf), "batches", handle)
    return out.read()


def _steps(part: str = "0") -> str:
    top = "path NOT LIKE '%/sub/%'"
    return rf"""file_events2 AS (SELECT *, {part} AS batch_id FROM file_events),
steps AS (
 SELECT batch_id, seq, watch_dir, path AS key, 'upsert' AS op, path, NULL AS old_path FROM file_events2 WHERE op IN ('create', 'modify') AND present AND {top}
 UNION ALL SELECT batch_id, seq, watch_dir, path, 'remove', path, NULL FROM file_events2 WHERE op = 'remove' AND {top}
 UNION ALL SELECT batch_id, seq, watch_dir, old_path, 'drop', path, NULL FROM file_events2 WHERE op = 'rename' AND present AND {top}
 UNION ALL SELECT batch_id, seq, watch_dir, path, 'drop', path, NULL FROM file_events2 WHERE op = 'rename' AND present AND {top}
 UNION ALL SELECT batch_id, seq, watch_dir, 'rename:'||old_path, 'rename', path, old_path FROM file_events2 WHERE op = 'rename' AND present AND {top}),
rescans AS (SELECT DISTINCT batch_id, watch_dir FROM file_events2 WHERE (op IN ('rename', 'modify') AND {top} AND NOT present)
  OR (op = 'rename_unpaired' AND ({top} OR old_path IS NOT NULL))),
changes AS (SELECT batch_id, watch_dir, arg_max(op, seq) AS op, arg_max(path, seq) AS path, max_by(coalesce(old_path, 'none'), seq) AS old_path
 FROM steps WHERE (batch_id, watch_dir) NOT IN (SELECT (batch_id, watch_dir) FROM rescans) GROUP BY batch_id, watch_dir, key HAVING arg_max(op, seq) <> 'drop')"""


@query("sm_02_directory_changes", rf"""WITH {D.FILE_EVENTS}, {_steps(PART)}
SELECT batch_id, watch_dir, op, path, old_path FROM changes UNION ALL SELECT batch_id, watch_dir, 'rescan', 'none', 'none' FROM rescans""")
def directory_changes(spark, sf):
    out = _table(spark, "changes", "watch_dir string, op string, path string, old_path string")
    play_batches(spark, views.file_events(spark, sf), "changes", ST.directory_changes(out))
    return out.read().select(
        "batch_id", "watch_dir", "op", F.coalesce("path", F.lit("none")).alias("path"), F.coalesce("old_path", F.lit("none")).alias("old_path")
    )


def _user_files(spark, sf):
    users = views.table(spark, sf, "events").select("user_id").distinct()
    dir_ = F.concat(F.lit("/w/d"), F.floor(C("user_id") / 20).cast("string"))
    return users.select(
        "user_id", dir_.alias("watch_dir"), F.concat(dir_, F.lit("/f"), C("user_id").cast("string"), F.lit(".log")).alias("path")
    )


USER_FILES = r"""user_files AS (SELECT DISTINCT user_id, '/w/d'||(user_id // 20) AS watch_dir, '/w/d'||(user_id // 20)||'/f'||user_id||'.log' AS path FROM events)"""


@query("sm_03_rescan_directories", rf"""WITH {D.FILE_EVENTS}, {_steps()}, {USER_FILES}
SELECT watch_dir, path FROM user_files WHERE watch_dir IN (SELECT watch_dir FROM rescans)""")
def rescan_directories(spark, sf):
    changes = H.normalize_directory_events(views.file_events(spark, sf))
    rescans = changes.where(C("op") == "rescan").select("watch_dir")
    return _user_files(spark, sf).join(rescans, "watch_dir", "left_semi").select("watch_dir", "path")


ARRIVAL_WORDS = r"""words AS (
 SELECT seq, 0 AS pos, path, 'schedule' AS action FROM file_events WHERE op = 'create' OR (op IN ('modify', 'rename_unpaired') AND present)
 UNION ALL SELECT seq, 0, path, 'cancel' FROM file_events WHERE op = 'remove' OR (op IN ('modify', 'rename_unpaired') AND NOT present)
 UNION ALL SELECT seq, 0, old_path, 'cancel' FROM file_events WHERE op = 'rename'
 UNION ALL SELECT seq, 1, path, 'schedule' FROM file_events WHERE op = 'rename')"""


@query("sm_04_arrival_words", rf"""WITH {D.FILE_EVENTS}, {ARRIVAL_WORDS}
SELECT {PART} AS batch_id, path, arg_max(action, seq * 2 + pos) AS action, false AS degraded FROM words GROUP BY ALL""")
def arrival_words(spark, sf):
    out = _table(spark, "words", "path string, action string")
    metrics = _table(spark, "metrics", "degraded boolean")
    play_batches(spark, views.file_events(spark, sf), "words", ST.arrival_words(out, metrics))
    return out.read().join(metrics.read(), "batch_id")


def _waits(spark, sf):
    events = views.table(spark, sf, "events")
    op = F.when(C("event_type") == "signup", F.lit("schedule")).when(
        (C("event_type") == "error") & (C("event_id") % 5 == 0), F.lit("cancel")
    ).otherwise(F.lit("sample"))
    path = F.concat(F.lit("/in/u"), (C("user_id") % 50).cast("string"))
    return events.select(C("event_id").alias("seq"), path.alias("path"), op.alias("op"), F.floor(C("value") / 40).alias("size"))


WAITS = r"""waits AS (SELECT event_id AS seq, '/in/u'||(user_id % 50) AS path, CASE WHEN event_type = 'signup' THEN 'schedule'
  WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'cancel' ELSE 'sample' END AS op, CAST(floor(value / 40) AS BIGINT) AS size FROM events),
gens AS (SELECT *, sum(CASE WHEN op = 'sample' THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY seq) AS gen FROM waits),
started AS (SELECT path, gen FROM gens WHERE op = 'schedule'),
numbered AS (SELECT g.path, g.gen, g.seq, g.size, row_number() OVER w AS n, lag(g.size) OVER w AS prev FROM gens g JOIN started USING (path, gen)
  WHERE g.op = 'sample' WINDOW w AS (PARTITION BY g.path, g.gen ORDER BY g.seq)),
marked AS (SELECT *, sum(CASE WHEN size = prev THEN 0 ELSE 1 END) OVER (PARTITION BY path, gen ORDER BY seq) AS run FROM numbered WHERE n <= 21),
runs AS (SELECT *, row_number() OVER (PARTITION BY path, gen, run ORDER BY seq) AS len FROM marked),
done AS (SELECT path, gen, min(seq) AS seq FROM runs WHERE len >= 4 OR n = 21 GROUP BY path, gen)"""


@query("sm_05_stable_arrivals", rf"""WITH {WAITS} SELECT d.path, d.seq, w.size FROM done d JOIN waits w ON w.seq = d.seq""")
def stable_arrivals(spark, sf):
    out = _table(spark, "arrived", "path string, seq bigint, size bigint")
    waiting = _table(spark, "waiting", "seq bigint, path string, op string, size bigint")
    play_batches(spark, _waits(spark, sf), "arrived", ST.stable_arrivals(out, waiting))
    return out.read().drop("batch_id")


@query("sm_05_stable_arrivals_batch", rf"""WITH {WAITS} SELECT d.path, d.seq, w.size FROM done d JOIN waits w ON w.seq = d.seq""")
def stable_arrivals_batch(spark, sf):
    return stability.arrivals(_waits(spark, sf))[0]


@query("sm_06_dirty_scopes", rf"""SELECT DISTINCT event_id // ((SELECT max(event_id) FROM events) // 3 + 1) AS batch_id, '/w/d'||(user_id // 20) AS watch_dir
FROM events WHERE event_id % 97 = 3""")
def dirty_scopes(spark, sf):
    op = F.when(C("seq") % 97 == 3, F.lit("overflow")).otherwise(C("op"))
    out = _table(spark, "dirty", "watch_dir string")
    play_batches(spark, views.file_events(spark, sf).withColumn("op", op), "dirty", ST.dirty_roots(out))
    return out.read()


# --- journals ---------------------------------------------------------------


@query("sm_07_resume_or_rebuild", rf"""WITH {D.JOURNAL}, {JOURNAL_STATE}
SELECT root, CASE WHEN root IN ('/v1', '/v2', '/v3') OR n - (SELECT count(*) FROM journal WHERE '/v'||(id % 5) = root AND seq < last // 2) > 1100 THEN 'rebuild' ELSE 'resume' END AS plan FROM state""")
def resume_or_rebuild(spark, sf):
    plan = H.resume_plan(*journal_positions(spark, sf))
    _, rebuild = H.catch_up_records(journal_with_root(spark, sf), plan, limit=1100)
    marked = plan.join(rebuild.withColumn("_again", F.lit(True)), "root", "left")
    return marked.select("root", F.when(C("_again").isNotNull(), F.lit("rebuild")).otherwise(F.lit("resume")).alias("plan"))


FINAL_TREE = r"""fdirs AS (SELECT * FROM final WHERE attributes & 16 <> 0),
tree(id, path) AS (SELECT id, '' FROM fdirs WHERE id <> 5 AND id = parent_id UNION ALL SELECT 5, ''
 UNION ALL SELECT d.id, t.path||'\'||d.name FROM fdirs d JOIN tree t ON d.parent_id = t.id WHERE d.id <> 5 AND d.id <> d.parent_id)"""


@query("sm_08_apply_journal", rf"""WITH RECURSIVE {D.FINAL_NODES}, {FINAL_TREE}
SELECT f.id, 'C:'||t.path||'\'||f.name AS path FROM final f JOIN tree t ON f.parent_id = t.id WHERE f.attributes & 16 = 0""")
def apply_journal(spark, sf):
    from logquarry.operators.nodes import resolve_files
    from logquarry.operators.trees import directory_cache

    first = views.user_nodes(spark, sf)
    nodes = _table(spark, "nodes", ST.NODE_LOG, first.withColumn("gone", F.lit(False)))
    dirs = _table(spark, "dirs", ST.DIR_LOG, directory_cache(first).withColumn("gone", F.lit(False)))
    begun = resolve_files(first, "C:").entries.select("id", "path", F.lit(False).alias("gone"))
    files = _table(spark, "files", ST.FILE_LOG, begun)
    play_batches(spark, views.journal(spark, sf), "journal", ST.journal_updates(nodes, dirs, files, "C:"))
    return ST.live_files(files)


@query("sm_08_apply_journal_batch", rf"""WITH RECURSIVE {D.FINAL_NODES}, {FINAL_TREE}
SELECT f.id, 'C:'||t.path||'\'||f.name AS path FROM final f JOIN tree t ON f.parent_id = t.id WHERE f.attributes & 16 = 0""")
def apply_journal_batch(spark, sf):
    from logquarry.operators.nodes import resolve_files

    first = views.user_nodes(spark, sf)
    begun = resolve_files(first, "C:").entries.select("id", "path")
    return H.apply_journal(first, begun, views.journal(spark, sf), "C:")[1]


@query("sm_09_overlapping_replay", rf"""WITH {D.FINAL_NODES} SELECT id, parent_id, name, seq FROM final""")
def overlapping_replay(spark, sf):
    journal = views.journal(spark, sf)
    top = journal.agg(F.max("seq")).first()[0] or 0
    # The position is taken at a third, the snapshot sees two thirds, the replay overlaps.
    snapshot = materialize(H.apply_records(views.user_nodes(spark, sf), journal.where(C("seq") < 2 * top / 3)), "snapshot")
    replayed = H.apply_records(snapshot, journal.where(C("seq") >= top / 3))
    return replayed.select("id", "parent_id", "name", "seq")


def _renames(spark, sf):
    events = views.table(spark, sf, "events")
    return events.select(
        C("event_id").alias("seq"),
        F.concat(F.lit("/p/"), C("user_id").cast("string")).alias("path"),
        F.concat(F.lit("NewName"), C("event_id").cast("string"), F.lit(".log")).alias("name"),
    )


@query("sm_10_search_columns_stream", r"""SELECT '/p/'||user_id AS path, 'log name'||max(event_id)||' new newname'||max(event_id) AS tokens FROM events GROUP BY user_id""")
def search_columns_stream(spark, sf):
    out = _table(spark, "tokens", "path string, tokens string")

    def derive(rows):
        return rows.select("path", F.array_join(F.array_sort(name_tokens(C("name"))), " ").alias("tokens"))

    play_batches(spark, _renames(spark, sf), "tokens", ST.catalog_feed(out, derive))
    return out.latest(["path"])


@query("sm_10_search_columns_batch", rf"""WITH {D.CATALOG}, feed AS (SELECT event_id AS seq, path, event_type <> 'error' AS up FROM events JOIN catalog ON user_id = doc_id),
last AS (SELECT path, arg_max(up, seq) AS up FROM feed GROUP BY path)
SELECT path, CASE WHEN up THEN 'new' ELSE 'old' END AS state FROM catalog LEFT JOIN last USING (path) WHERE up IS NULL OR up""")
def search_columns_batch(spark, sf):
    from logquarry.queries.table_queries import _feed

    rows = views.catalog(spark, sf)
    derived = rows.select("path", F.lit("old").alias("state"))
    kept = H.maintain_search_columns(derived, _feed(spark, sf), rows, lambda r: r.select("path", F.lit("new").alias("state")))
    return kept


@query("sm_11_path_events", rf"""WITH {D.CATALOG}, docs AS (SELECT doc_id, path, parent, size, source FROM catalog),
touched AS (SELECT DISTINCT CASE WHEN event_id % 500 = 0 THEN parent ELSE path END AS t FROM events JOIN docs ON user_id * 7 = doc_id WHERE source <> 'src3'),
listing AS (SELECT path, size + 1 AS size FROM docs WHERE doc_id % 3 <> 0 AND source <> 'src3'),
fresh AS (SELECT DISTINCT l.path, l.size FROM listing l JOIN touched ON l.path = t OR starts_with(l.path, t||'/')),
missing AS (SELECT t FROM touched WHERE NOT EXISTS (SELECT 1 FROM listing l WHERE l.path = t OR starts_with(l.path, t||'/'))),
gone AS (SELECT c.path FROM docs c JOIN missing ON c.path = t OR starts_with(c.path, t||'/'))
SELECT path, size FROM fresh UNION ALL SELECT path, size FROM docs WHERE doc_id % 5 <> 0 AND path NOT IN (SELECT path FROM fresh) AND path NOT IN (SELECT path FROM gone)""")
def path_events(spark, sf):
    rows = views.catalog(spark, sf)
    wanted = views.table(spark, sf, "events").select("event_id", (C("user_id") * 7).alias("doc_id"))
    events = wanted.join(rows, "doc_id").select(F.when(C("event_id") % 500 == 0, C("parent")).otherwise(C("path")).alias("path"))
    listing = rows.where(C("doc_id") % 3 != 0).select("path", (C("size") + 1).alias("size"))
    current = rows.where(C("doc_id") % 5 != 0).select("path", "size")
    return H.apply_path_events(current, events, listing, ["/data/src3"])


# --- notifications ----------------------------------------------------------


def _notices(spark, sf):
    events = views.table(spark, sf, "events")
    op = F.when(C("event_type").isin("signup", "view", "purchase"), F.lit("arrive")).when(C("event_type") == "click", F.lit("read")).otherwise(F.lit("remove"))
    path = F.concat(F.lit("/n/"), C("user_id").cast("string"), F.lit("-"), (C("event_id") % 30).cast("string"))
    return events.select(C("event_id").alias("seq"), path.alias("path"), op.alias("op"))


NOTICES = r"""notices AS (SELECT event_id AS seq, '/n/'||user_id||'-'||(event_id % 30) AS path,
 CASE WHEN event_type IN ('signup', 'view', 'purchase') THEN 'arrive' WHEN event_type = 'click' THEN 'read' ELSE 'remove' END AS op FROM events),
facts AS (SELECT path, min(seq) FILTER (op = 'arrive') AS first_arrival, max(seq) FILTER (op = 'arrive') AS last_arrival,
 min(seq) FILTER (op = 'read') AS first_read, max(seq) FILTER (op <> 'arrive') AS last_end FROM notices GROUP BY path),
unread AS (SELECT path, first_arrival AS seq FROM facts WHERE first_arrival IS NOT NULL AND coalesce(first_read > first_arrival, true) AND coalesce(last_end < first_arrival, true))"""


@query("sm_12_unread", rf"""WITH {NOTICES} SELECT path, seq FROM unread""")
def unread_stream(spark, sf):
    out = _table(spark, "facts", ST.FACTS)
    play(spark, _notices(spark, sf), "facts", lambda stream, checkpoint: ST.unread_stream(stream, out, checkpoint, True))
    return ST.unread(out.latest(["path"]))


@query("sm_12_unread_repeated", rf"""WITH {NOTICES} SELECT path, last_arrival AS seq FROM facts WHERE last_arrival IS NOT NULL AND coalesce(last_end < last_arrival, true) AND last_arrival > 1000""")
def unread_repeated(spark, sf):
    return ST.unread(ST.unread_facts(_notices(spark, sf)), all_read_at=1000, repeat=True)


@query("ag_10_unread_count", rf"""WITH {NOTICES} SELECT count(*) AS n FROM unread""")
def unread_count(spark, sf):
    return ST.unread(ST.unread_facts(_notices(spark, sf))).agg(F.count(F.lit(1)).alias("n"))


def _detected(spark, sf):
    rows = views.catalog(spark, sf)
    return rows.select(C("doc_id").alias("seq"), "path", "name", "is_archive")


@query("sm_13_notifications", rf"""WITH {D.CATALOG}
SELECT doc_id AS seq, path FROM catalog WHERE source IN ('src1', 'src7') AND (is_archive OR name LIKE '%.log')""")
def notify(spark, sf):
    return ST.notifications(_detected(spark, sf), ["/data/src1", "/data/src7"], [".LOG"]).select("seq", "path")


@query("sm_14_source_prompts", r"""WITH p AS (SELECT event_id AS seq, 'c:/s/u'||(user_id % 40)||'-'||(event_id % 25) AS source, CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'deleted' ELSE 'modified' END AS kind, 'r'||event_id AS revision FROM events)
SELECT source, arg_max(kind, CASE WHEN kind = 'deleted' THEN 1000000000000 ELSE 0 END + seq) AS kind,
 arg_max(revision, CASE WHEN kind = 'deleted' THEN 1000000000000 ELSE 0 END + seq) AS revision FROM p GROUP BY source""")
def source_prompts(spark, sf):
    user, slot = (C("user_id") % 40).cast("string"), (C("event_id") % 25).cast("string")
    path = F.when(C("event_id") % 2 == 0, F.concat(F.lit("C:\\S\\U"), user, F.lit("-"), slot)).otherwise(F.concat(F.lit("c:/s/u"), user, F.lit("-"), slot))
    kind = F.when((C("event_type") == "error") & (C("event_id") % 4 == 0), F.lit("deleted")).otherwise(F.lit("modified"))
    events = views.table(spark, sf, "events").select(
        C("event_id").alias("seq"), path.alias("path"), kind.alias("kind"), F.concat(F.lit("r"), C("event_id").cast("string")).alias("revision")
    )
    return H.source_prompts(events)


@query("sm_15_apply_directory_changes", rf"""WITH {D.FILE_EVENTS}, {_steps()}, {USER_FILES},
before AS (SELECT watch_dir, path, 'c'||user_id AS children FROM user_files WHERE user_id % 2 = 0),
gone AS (SELECT watch_dir, path FROM changes WHERE op = 'remove' UNION SELECT watch_dir, old_path FROM changes WHERE op = 'rename'),
rows AS (SELECT watch_dir, path FROM before WHERE watch_dir NOT IN (SELECT watch_dir FROM rescans) AND (watch_dir, path) NOT IN (SELECT (watch_dir, path) FROM gone)
 UNION SELECT watch_dir, path FROM changes WHERE op IN ('upsert', 'rename')
 UNION SELECT watch_dir, path FROM user_files WHERE user_id % 3 = 0 AND watch_dir IN (SELECT watch_dir FROM rescans))
SELECT r.watch_dir, r.path, coalesce(children, 'none') AS children FROM rows r LEFT JOIN before USING (watch_dir, path)""")
def apply_directory_changes(spark, sf):
    files = _user_files(spark, sf)
    before = files.where(C("user_id") % 2 == 0).select("watch_dir", "path", F.concat(F.lit("c"), C("user_id").cast("string")).alias("children"))
    changes = materialize(H.normalize_directory_events(views.file_events(spark, sf)), "directory_changes")
    listing = files.where(C("user_id") % 3 == 0).select("watch_dir", "path")
    after = H.apply_directory_changes(before, changes, listing)
    return after.select("watch_dir", "path", F.coalesce("children", F.lit("none")).alias("children"))


@query("sm_16_partial_results", rf"""WITH {D.CATALOG}
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN size + 5 ELSE size END AS size, true AS partial FROM catalog WHERE contains(path, 'src1/') ORDER BY length(name), lower(name), lower(path) LIMIT 40""")
def partial_results(spark, sf):
    rows = views.catalog(spark, sf)
    arriving = rows.where(C("doc_id") % 4 == 0).withColumn("size", C("size") + 5)
    found = ST.partial_search(rows, arriving, "src1/", ready=False, limit=40)
    flag = found.stats.select("partial")
    return found.items.select("doc_id", "size").withColumn("partial", F.lit(flag.first()[0]))


@query("sm_17_growing_lines", rf"""WITH {FILE_ROWS} SELECT bucket, line_no, content FROM file_rows""")
def growing_lines(spark, sf):
    out = _table(spark, "lines", ST.LINES)
    stream = ST.line_stream(spark, written_lines(spark, sf))
    ST.finish(ST.run(stream, ST.publish_lines(out), work_path(spark, "lines_checkpoint"), True))
    return _bucketed(out.read()).select("bucket", "line_no", "content")


@query("sm_18_change_encoding", rf"""WITH {D.LINES} SELECT doc_id, line_no, content FROM file_lines""")
def change_encoding(spark, sf):
    from logquarry.functions.text import lenient_charsets
    from logquarry.sources.textlines import lines_of_content

    docs = views.table(spark, sf, "documents")
    with lenient_charsets(spark):
        raw = docs.select("doc_id", F.encode("text", "GB18030").alias("content"))
    guessed = lines_of_content(raw, "utf-8").drop("charset")
    store = Snapshots(spark, work_path(spark, "recoded"), guessed.schema)
    store.replace(guessed, "UTF-8")
    store.replace(lines_of_content(raw, " gb18030 ").drop("charset"), "GB18030")
    return store.read()


@query("sm_19_overlapping_roots", rf"""WITH {D.CATALOG}
SELECT doc_id AS seq, path FROM catalog WHERE source = 'src1' AND (is_archive OR name LIKE '%.log')""")
def overlapping_roots(spark, sf):
    from logquarry.operators.roots import minimal_roots

    asked = spark.createDataFrame([("/data/src1",), ("/data/src1/en",), ("/data/src1/",)], "root string")
    roots = [row[0] for row in minimal_roots(asked).collect()]
    twice = _detected(spark, sf).unionByName(_detected(spark, sf).withColumn("seq", C("seq") + 1_000_000))
    return ST.notifications(twice, roots, [".log"]).select("seq", "path")
