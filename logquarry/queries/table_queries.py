"""Joins, aggregates, windows, orders and set operations over whole tables."""

from pyspark.sql import functions as F

from logquarry.constants import MAX_KEPT_RESULTS, MAX_PAGE
from logquarry.operators import changes as H
from logquarry.operators import lines as L
from logquarry.operators import nodes as N
from logquarry.operators import roots as R
from logquarry.operators import search as S
from logquarry.operators.stability import stable_sizes
from logquarry.plans import views
from logquarry.plans.blocked import id_block
from logquarry.queries import duck as D
from logquarry.queries.path_queries import ROOTS
from logquarry.queries.path_queries import _token_sql
from logquarry.queries.registry import query
from logquarry.sources import files as FS
from logquarry.sources.snapshots import usable

C = F.col


# --- derived inputs ---------------------------------------------------------


def _doc_roots(spark, sf):
    """A root for each (source, language) of even documents, each odd source, each ZIP."""
    docs = views.table(spark, sf, "documents")
    number = F.substring("source", 4, 9).cast("int")
    narrow = docs.where(C("doc_id") % 2 == 0).select(F.concat(F.lit("/data/"), "source", F.lit("/"), "lang").alias("root"))
    wide = docs.where(number % 2 == 1).select(F.concat(F.lit("/data/"), "source").alias("root"))
    zips = views.files(spark, sf).where(C("doc_id") % 10 == 0).select(C("path").alias("root"))
    return narrow.unionByName(wide).unionByName(zips).distinct()


DOC_ROOTS = r"""doc_roots AS (
 SELECT '/data/'||source||'/'||lang AS root FROM documents WHERE doc_id % 2 = 0
 UNION SELECT '/data/'||source FROM documents WHERE CAST(substr(source, 4) AS INTEGER) % 2 = 1
 UNION SELECT '/data/'||source||'/'||lang||'/doc-'||doc_id||'.zip' FROM documents WHERE doc_id % 10 = 0)"""


# --- joins ------------------------------------------------------------------


@query("jn_01_most_specific_root", rf"""WITH {D.CATALOG}, {DOC_ROOTS}
SELECT doc_id, coalesce(max_by(root, length(root)), 'none') AS root
FROM catalog LEFT JOIN doc_roots ON path = root OR starts_with(path, root||'/') GROUP BY doc_id""")
def most_specific_root(spark, sf):
    rooted = R.with_root(views.files(spark, sf), _doc_roots(spark, sf))
    return rooted.select("doc_id", F.coalesce("root", F.lit("none")).alias("root"))


@query("jn_01_most_specific_root_inline", rf"""WITH {D.CATALOG}, {D.ROOTS}
SELECT doc_id, coalesce(max_by(root, length(root)), 'none') AS root
FROM catalog LEFT JOIN roots ON starts_with(path, root||'/') GROUP BY doc_id""")
def most_specific_root_inline(spark, sf):
    rooted = R.with_root(views.files(spark, sf), ROOTS)
    return rooted.select("doc_id", F.coalesce("root", F.lit("none")).alias("root"))


@query("jn_02_drop_excluded", rf"""WITH {D.CATALOG}, {DOC_ROOTS}
SELECT doc_id, path FROM catalog WHERE NOT EXISTS (
 SELECT 1 FROM doc_roots WHERE len(string_split(root, '/')) <> 4 AND (path = root OR starts_with(path, root||'/')))""")
def drop_excluded(spark, sf):
    from logquarry.functions.paths import depth

    excluded = _doc_roots(spark, sf).where(depth(C("root")) != 3)
    return R.without_excluded(views.files(spark, sf), excluded).select("doc_id", "path")


TREE = r"""tree(id, path) AS (
 SELECT id, '' FROM dirs WHERE id <> 5 AND attributes & 1024 = 0 AND (id = parent_id OR name = '.')
 UNION ALL SELECT 5, ''
 UNION ALL SELECT d.id, t.path||'\'||d.name FROM dirs d JOIN tree t ON d.parent_id = t.id
   WHERE d.id <> 5 AND d.id <> d.parent_id AND d.name <> '.' AND d.attributes & 1024 = 0)"""


@query("jn_03_resolve_files", rf"""WITH RECURSIVE {D.NODES}, {TREE}
SELECT f.id, f.parent_id, 'C:'||t.path||'\'||f.name AS path, f.name FROM last f JOIN tree t ON f.parent_id = t.id
WHERE f.attributes & 16 = 0""")
def resolve_files(spark, sf):
    return N.resolve_files(views.nodes(spark, sf), "C:\\").entries.select("id", "parent_id", "path", "name")


ALL_TREE = r"""tree(id, path) AS (
 SELECT id, '' FROM last WHERE id = parent_id OR name = '.'
 UNION ALL SELECT d.id, t.path||'\'||d.name FROM last d JOIN tree t ON d.parent_id = t.id WHERE d.id <> d.parent_id AND d.name <> '.')"""


@query("jn_04_resolve_all_entries", rf"""WITH RECURSIVE {D.NODES}, {ALL_TREE}
SELECT id, 'C:'||path AS path FROM tree WHERE path <> ''""")
def resolve_all(spark, sf):
    return N.resolve_all(views.nodes(spark, sf), "C:").select("id", "path")


def _changed(nodes):
    changed = (C("id") % 41 == 3) | (C("id") == 31)
    return nodes.where(changed).select("id", N.is_directory(C("attributes")).alias("is_dir"))


@query("jn_05_affected_files", rf"""WITH RECURSIVE {D.NODES},
hit(id) AS (SELECT id FROM dirs WHERE id % 41 = 3 OR id = 31
  UNION SELECT n.id FROM last n JOIN hit h ON n.parent_id = h.id WHERE n.id <> n.parent_id)
SELECT id FROM last WHERE attributes & 16 = 0 AND (id % 41 = 3 OR id = 31 OR parent_id IN (SELECT id FROM hit))""")
def affected(spark, sf):
    nodes = N.latest_records(views.nodes(spark, sf))
    return N.affected_files(nodes, _changed(nodes))


def _feed(spark, sf):
    """Change log of catalog paths: the event's number picks a document."""
    events = views.table(spark, sf, "events")
    docs = views.files(spark, sf).select("doc_id", "path")
    named = events.select(C("event_id").alias("seq"), C("user_id").alias("doc_id"), (C("event_type") != "error").cast("int").alias("op"))
    return named.join(docs, "doc_id").select("seq", "path", "op")


FEED = r"""feed AS (SELECT event_id AS seq, path, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS op
 FROM events JOIN catalog ON user_id = doc_id)"""


@query("jn_06_changed_rows", rf"""WITH {D.CATALOG}, {FEED}
SELECT doc_id, path, size FROM catalog WHERE path IN (SELECT path FROM feed GROUP BY path HAVING arg_max(op, seq) = 1)""")
def changed_rows(spark, sf):
    return H.changed_rows(_feed(spark, sf), views.catalog(spark, sf)).select("doc_id", "path", "size")


@query("jn_07_candidates_semi_join", rf"""WITH {D.CATALOG} SELECT doc_id, path FROM catalog WHERE contains(path, 'src11/en')""")
def candidates(spark, sf):
    rows = views.catalog(spark, sf)
    # Trigrams give candidates; the exact test follows the join.
    found = S.trigram_candidates(S.trigram_table(rows), ["src11/en"])
    return rows.join(found, "path", "left_semi").where(S.has_substrings(["src11/en"])).select("doc_id", "path")


@query("jn_08_page_details", rf"""WITH {D.CATALOG}, page AS (SELECT * FROM catalog WHERE contains(path, 'src1') ORDER BY length(name), lower(name), lower(path) LIMIT 100)
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE size END AS size, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE modified_ms END AS modified_ms,
 doc_id % 7 <> 0 AS readable, CASE doc_id % 10 WHEN 0 THEN 'application/zip' WHEN 1 THEN 'application/gzip' WHEN 4 THEN 'application/octet-stream'
  WHEN 6 THEN 'application/octet-stream' ELSE 'text/plain' END AS content_type FROM page""")
def page_details(spark, sf):
    rows = views.catalog(spark, sf)
    found = S.page(S.matching(rows, "src1/ data/").unionByName(rows.where(F.contains("path", F.lit("src1")) & ~S.has_substrings(["src1/"]))), S.path_order(), 0, 100)
    listing = rows.where(C("doc_id") % 7 != 0).select("path", "size", "modified_ms")
    return S.page_details(found, listing).select(
        "doc_id", "size", F.coalesce("modified_ms", F.lit(-1)).alias("modified_ms"), "readable", "content_type"
    )


def _revisions(spark, sf):
    docs = views.files(spark, sf)
    known = docs.where(C("doc_id") % 5 != 0).select("path", C("size").cast("string").alias("revision"))
    bumped = F.when(C("doc_id") % 3 == 0, C("size") + 1).otherwise(C("size"))
    current = docs.where(C("doc_id") % 7 != 0).select("path", bumped.cast("string").alias("revision"))
    return known, current


@query("jn_09_revision_check", rf"""WITH {D.CATALOG}
SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'deleted' WHEN doc_id % 5 = 0 THEN 'first_seen' WHEN doc_id % 3 = 0 THEN 'modified' ELSE 'same' END AS change
FROM catalog WHERE doc_id % 7 <> 0 OR doc_id % 5 <> 0""")
def revision_check(spark, sf):
    return H.compare_revisions(*_revisions(spark, sf))


@query("jn_10_vanished_nodes", rf"""WITH {D.CATALOG} SELECT doc_id, path FROM catalog WHERE doc_id % 4 = 3""")
def vanished(spark, sf):
    docs = views.files(spark, sf)
    return H.vanished(docs, docs.where(C("doc_id") % 4 != 3), "path").select("doc_id", "path")


@query("jn_11_directories_with_unread", rf"""WITH {D.CATALOG}
SELECT DISTINCT parent AS path FROM catalog WHERE parent IN (SELECT parent FROM catalog WHERE doc_id % 29 = 3)""")
def directories_with_unread(spark, sf):
    rows = views.catalog(spark, sf)
    dirs = rows.select(C("parent").alias("path")).distinct()
    return R.directories_with(dirs, rows.where(C("doc_id") % 29 == 3))


@query("jn_12_is_covered", rf"""WITH {D.CATALOG}, {DOC_ROOTS}
SELECT doc_id, bool_or(root IS NOT NULL) AS covered FROM catalog LEFT JOIN doc_roots ON path = root OR starts_with(path, root||'/') GROUP BY doc_id""")
def is_covered(spark, sf):
    return R.is_covered(views.files(spark, sf), _doc_roots(spark, sf)).select("doc_id", "covered")


@query("jn_13_keep_children", rf"""WITH {D.CATALOG}
SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'none' ELSE 'c'||doc_id END AS children FROM catalog WHERE doc_id % 2 = 0""")
def keep_children(spark, sf):
    docs = views.files(spark, sf)
    before = docs.where(C("doc_id") % 3 != 0).select("path", F.concat(F.lit("c"), C("doc_id").cast("string")).alias("children"))
    after = docs.where(C("doc_id") % 2 == 0).select("path")
    return H.keep_children(after, before, ["path"]).select("path", F.coalesce("children", F.lit("none")).alias("children"))


# --- aggregates -------------------------------------------------------------


@query("ag_01_total_matches", rf"""WITH {D.CATALOG} SELECT count(*) AS total, false AS partial FROM catalog WHERE contains(path, '/data/src1') AND is_log AND NOT is_archive""")
def total_matches(spark, sf):
    return S.search(views.catalog(spark, sf), "/DATA/src1 doc", "log").stats


@query("ag_02_catalog_count", "SELECT count(*) AS n FROM documents")
def catalog_count(spark, sf):
    return views.files(spark, sf).agg(F.count(F.lit(1)).alias("n"))


@query("ag_03_lines_per_file", rf"""WITH {D.LINES} SELECT doc_id, count(*) AS n_lines FROM file_lines GROUP BY doc_id""")
def lines_per_file(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", "text")
    return L.line_counts(L.split_text(docs), "doc_id")


@query("ag_05_chain_bytes", r"""SELECT source, lang, CAST(sum(n_chars) AS BIGINT) AS decoded, sum(n_chars) <= 100000 AS within_limit FROM documents GROUP BY source, lang""")
def chain_bytes(spark, sf):
    docs = views.table(spark, sf, "documents")
    sums = docs.groupBy("source", "lang").agg(F.sum("n_chars").alias("decoded"))
    return sums.withColumn("within_limit", C("decoded") <= 100_000)


@query("ag_06_tree_diagnostics", rf"""WITH RECURSIVE {D.NODES},
lookups AS (SELECT parent_id AS cur FROM last WHERE attributes & 16 = 0 AND parent_id <> 5),
reached(cur) AS (SELECT DISTINCT cur FROM lookups
  UNION SELECT d.parent_id FROM dirs d JOIN reached r ON d.id = r.cur
    WHERE d.attributes & 1024 = 0 AND d.id <> d.parent_id AND d.name <> '.' AND d.parent_id <> 5 AND d.id <> 5),
walked AS (SELECT d.* FROM dirs d JOIN reached r ON d.id = r.cur),
good AS (SELECT * FROM walked WHERE attributes & 1024 = 0 AND id <> parent_id AND name <> '.' AND parent_id <> 5 AND id <> 5)
SELECT (SELECT count(*) FROM lookups WHERE cur NOT IN (SELECT id FROM dirs)) + (SELECT count(*) FROM good WHERE parent_id NOT IN (SELECT id FROM dirs)) AS orphan,
 (SELECT count(*) FROM good a JOIN good b ON a.parent_id = b.id AND b.parent_id = a.id AND a.id < b.id) AS cyclic,
 (SELECT count(*) - count(DISTINCT id) FROM nodes) AS duplicate,
 (SELECT count(*) FROM walked WHERE attributes & 1024 <> 0 AND id <> 5) AS reparse""")
def tree_diagnostics(spark, sf):
    nodes = views.nodes(spark, sf)
    return N.diagnostics(nodes, N.resolve_files(nodes, "C:"))


@query("ag_07_duplicate_ids", rf"""WITH {D.NODES} SELECT id, parent_id, name, attributes, seq FROM last""")
def duplicate_ids(spark, sf):
    return N.latest_records(views.nodes(spark, sf))


@query("ag_08_scan_counters", rf"""WITH {D.CATALOG} SELECT count(*) AS indexed, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (is_log) AS logs FROM catalog""")
def scan_counters(spark, sf):
    from logquarry.session import materialize

    counted, seen = FS.observed(views.catalog(spark, sf))
    materialize(counted, "observed")
    facts = seen.get
    return spark.createDataFrame([(facts["indexed"], facts["bytes"], facts["logs"])], "indexed bigint, bytes bigint, logs bigint")


@query("ag_09_status_by_root", r"""SELECT '/r'||(user_id % 20) AS root, arg_max(event_type, event_id) AS provider, arg_max(props, event_id) AS phase,
 'u'||arg_max(user_id, event_id) AS reason FROM events GROUP BY user_id % 20""")
def status_by_root(spark, sf):
    events = views.table(spark, sf, "events").select(
        F.concat(F.lit("/r"), (C("user_id") % 20).cast("string")).alias("root"),
        C("event_type").alias("provider"),
        C("props").alias("phase"),
        F.concat(F.lit("u"), C("user_id").cast("string")).alias("reason"),
        C("event_id").alias("seq"),
    )
    return FS.status_by_root(events)


@query("ag_11_snapshot_usable", rf"""SELECT CAST(count(*) AS BIGINT) AS n_catalog, CAST(count(*) FILTER (doc_id % 3 <> 0) AS BIGINT) AS n_derived, true AS usable FROM documents""")
def snapshot_usable(spark, sf):
    rows = views.files(spark, sf)
    return usable(rows, rows.where(C("doc_id") % 3 != 0), True)


@query("ag_12_directory_bytes", "SELECT CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents")
def directory_bytes(spark, sf):
    return FS.total_bytes(views.files(spark, sf))


@query("ag_13_distinct_path_keys", rf"""WITH s AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'C:\Logs\U'||user_id ELSE 'c:/logs/u'||user_id END AS path FROM events)
SELECT lower(replace(min_by(path, event_id), '/', '\')) AS key, min_by(path, event_id) AS path, min(event_id) AS event_id FROM s GROUP BY lower(replace(path, '/', '\'))""")
def distinct_path_keys(spark, sf):
    rows = _respelled(spark, sf)
    from logquarry.functions.paths import path_key

    return S.first_by_key(rows, C("event_id")).select(path_key(C("path")).alias("key"), "path", "event_id")


def _respelled(spark, sf):
    user = C("user_id").cast("string")
    path = F.when(C("event_id") % 3 == 0, F.concat(F.lit("C:\\Logs\\U"), user)).otherwise(F.concat(F.lit("c:/logs/u"), user))
    return views.table(spark, sf, "events").select("event_id", path.alias("path"))


# --- windows ----------------------------------------------------------------


@query("wn_01_line_numbers", rf"""WITH {D.LEVELS}
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line_no FROM level_lines""")
def line_numbers(spark, sf):
    lines = views.level_lines(spark, sf)
    return L.number_lines(lines, ["user_id"], "event_id", id_block("event_id")).select("event_id", "user_id", "line_no")


@query("wn_02_line_offsets", rf"""WITH {D.LEVELS}
SELECT user_id, event_id, octet_length(encode(line)) + 1 AS byte_len, row_number() OVER w AS line_no,
 CAST(coalesce(sum(octet_length(encode(line)) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start
FROM level_lines WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def line_offsets(spark, sf):
    lines = views.level_lines(spark, sf)
    return L.line_offsets(lines, ["user_id"], "event_id", id_block("event_id"), "line")


@query("wn_03_raw_lengths", rf"""WITH {D.LEVELS}, n AS (SELECT user_id, row_number() OVER w AS line_no, octet_length(encode(line)) + 1 AS raw_len,
 lead(event_id) OVER w AS nxt FROM level_lines WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, line_no, CASE WHEN nxt IS NULL THEN -1 ELSE raw_len END AS raw_len FROM n""")
def raw_lengths(spark, sf):
    lines = views.level_lines(spark, sf)
    index = L.line_offsets(lines, ["user_id"], "event_id", id_block("event_id"), "line")
    return L.raw_lengths(index.select("user_id", "line_no", "byte_start"), ["user_id"]).select(
        "user_id", "line_no", F.coalesce("raw_len", F.lit(-1)).alias("raw_len")
    )


@query("wn_04_last_change_wins", rf"""WITH {D.JOURNAL}
SELECT id, max(seq) AS seq, arg_max(name, seq) AS name, arg_max(reason, seq) AS reason FROM journal GROUP BY id""")
def last_change(spark, sf):
    return H.last_per_key(views.journal(spark, sf).select("id", "seq", "name", "reason"), ["id"])


STABLE = r"""numbered AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq) AS n, lag(size) OVER (PARTITION BY path ORDER BY seq) AS prev FROM samples),
marked AS (SELECT *, sum(CASE WHEN size = prev THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY seq) AS run FROM numbered WHERE n <= 21),
runs AS (SELECT *, row_number() OVER (PARTITION BY path, run ORDER BY seq) AS len FROM marked),
done AS (SELECT path, min(seq) AS seq FROM runs WHERE len >= 4 OR n = 21 GROUP BY path)"""


@query("wn_05_stable_size", rf"""WITH {D.SAMPLES}, {STABLE} SELECT d.path, d.seq, s.size FROM done d JOIN samples s ON s.seq = d.seq""")
def stable_size(spark, sf):
    return stable_sizes(views.size_samples(spark, sf))


@query("wn_06_first_line", rf"""WITH {D.LINES} SELECT doc_id, content FROM file_lines WHERE line_no = 1""")
def first_line(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("\ufeff"), "text").alias("text"))
    return L.first_lines(L.split_text(docs)).select("doc_id", "content")


# --- order and top-k --------------------------------------------------------


@query("sr_01_token_rank", rf"""WITH {D.CATALOG}
SELECT doc_id, path FROM catalog WHERE name LIKE '%.log'
 ORDER BY CASE WHEN lower(name) = 'log doc' THEN 0 WHEN starts_with(lower(name), 'log doc') THEN 1 WHEN contains(lower(name), 'log doc') THEN 2 ELSE 3 END, lower(name), lower(path), path LIMIT 50""")
def token_rank(spark, sf):
    return S.search(views.catalog(spark, sf), "log DOC", None, 0, 50).items.select("doc_id", "path")


CASES = r"""cased AS (SELECT doc_id, copy, '/'||CASE copy WHEN 0 THEN 'D' ELSE 'd' END||'/'||source||'/Report.log' AS path FROM documents, (SELECT 0 AS copy UNION ALL SELECT 1) c),
 ordered AS (SELECT path, count(*) AS n FROM cased GROUP BY path ORDER BY lower(path), path)"""


@query("sr_01_case_ties", rf"""WITH {CASES} SELECT path, n, row_number() OVER (ORDER BY lower(path), path) <= 7 AS near FROM ordered""")
def case_ties(spark, sf):
    """Paths that differ by case only: two pages together hold each of them once."""
    docs = views.table(spark, sf, "documents").select("source", F.explode(F.array(F.lit("D"), F.lit("d"))).alias("disk"))
    rows = docs.select(F.concat(F.lit("/"), "disk", F.lit("/"), "source", F.lit("/Report.log")).alias("path"))
    rows = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit("Report.log"))
    rows = rows.withColumn("is_log", F.lit(True)).withColumn("is_archive", F.lit(False))
    pages = [S.search(rows, "report", None, at, size).items.select("path", "n", F.lit(at == 0).alias("near")) for at, size in ((0, 7), (7, 10_000))]
    return pages[0].unionByName(pages[1])


@query("sr_02_path_order", rf"""WITH {D.CATALOG}
SELECT doc_id, path FROM catalog WHERE contains(lower(name||' '||path), 'src1/') ORDER BY length(name), lower(name), lower(path) LIMIT 30""")
def path_order(spark, sf):
    return S.search(views.catalog(spark, sf), "src1/", None, 0, 30).items.select("doc_id", "path")


INVENTORY = r"""inventory AS (
 SELECT path, name, CASE WHEN is_archive THEN 'archive' ELSE 'file' END AS kind, size, is_archive OR is_log AS is_log FROM catalog WHERE parent = '/data/src1/en'
 UNION ALL SELECT DISTINCT '/data/src1/en/sub'||(doc_id % 4), 'sub'||(doc_id % 4), 'dir', 0, false FROM catalog WHERE parent = '/data/src2/en')"""


def _tree_listing(spark, sf):
    rows = views.catalog(spark, sf)
    deeper = rows.where(C("parent") == "/data/src2/en").withColumn(
        "path", F.concat(F.lit("/data/src1/en/sub"), (C("doc_id") % 4).cast("string"), F.lit("/"), "name")
    )
    return rows.unionByName(deeper)


@query("sr_03_inventory_order", rf"""WITH {D.CATALOG}, {INVENTORY}
SELECT path, kind, row_number() OVER (ORDER BY kind <> 'dir', lower(name), path) AS position FROM inventory""")
def inventory_order(spark, sf):
    listed = FS.inventory(_tree_listing(spark, sf), "/data/src1/en")
    return S.ranked(listed, FS.inventory_order()).select("path", "kind", "position")


@query("sr_04_deep_page", rf"""WITH {D.CATALOG}
SELECT doc_id, path FROM catalog ORDER BY length(name), lower(name), lower(path) LIMIT 100 OFFSET 150""")
def deep_page(spark, sf):
    return S.page(views.catalog(spark, sf), S.path_order(), 150, 100).select("doc_id", "path")


@query("sr_04_positions", rf"""WITH {D.CATALOG}
SELECT doc_id, row_number() OVER (ORDER BY length(name), lower(name), lower(path)) AS position FROM catalog""")
def positions(spark, sf):
    return S.ranked(views.catalog(spark, sf), S.path_order()).select("doc_id", "position")


@query("sr_05_exact_candidates", rf"""WITH {D.CATALOG}
SELECT doc_id FROM catalog WHERE doc_id % 10 IN (2) ORDER BY lower(name), lower(path) LIMIT 500""")
def exact_candidates(spark, sf):
    return S.search(views.catalog(spark, sf), "txt", None, 0, 9_999, most=MAX_PAGE).items.select("doc_id")


@query("sr_06_line_range", rf"""WITH {D.LINES} SELECT doc_id, line_no, content FROM file_lines WHERE line_no BETWEEN 4 AND 9""")
def line_range(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", "text")
    return L.read_range(L.split_text(docs), 3, 6).select("doc_id", "line_no", "content")


@query("sr_07_capped_results", rf"""WITH s AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'C:\Logs\U'||user_id ELSE 'c:/logs/u'||user_id END AS path FROM events),
k AS (SELECT lower(replace(path, '/', '\')) AS key, event_id % 2 AS side, event_id, path FROM s),
first AS (SELECT DISTINCT ON (key) path, side, event_id FROM k ORDER BY key, side, event_id)
SELECT event_id, path FROM first ORDER BY side, event_id LIMIT 40""")
def capped_results(spark, sf):
    rows = _respelled(spark, sf)
    merged = S.merge_pages(rows.where(C("event_id") % 2 == 0), rows.where(C("event_id") % 2 == 1), "event_id", 40)
    return merged.select("event_id", "path")


@query("sr_08_newest_first", r"""SELECT '/in/u'||user_id||'.log' AS path, min(event_id) AS seq, row_number() OVER (ORDER BY min(event_id) DESC) AS position FROM events GROUP BY user_id""")
def newest_first(spark, sf):
    from logquarry.streaming.streams import newest_first as order

    first = views.size_samples(spark, sf).groupBy("path").agg(F.min("seq").alias("seq"))
    return S.ranked(first, order())


@query("sr_09_sorted_paths", rf"""WITH RECURSIVE {D.NODES}, {ALL_TREE} SELECT 'C:'||path AS path, row_number() OVER (ORDER BY path) AS position FROM tree WHERE path <> ''""")
def sorted_paths(spark, sf):
    return S.ranked(N.resolve_all(views.nodes(spark, sf), "C:").select("path"), [C("path")])


@query("sr_10_trigram_order", rf"""WITH {D.CATALOG}
SELECT doc_id FROM catalog WHERE contains(lower(name||' '||path), 'doc-11') AND contains(lower(name||' '||path), 'log')
ORDER BY CASE WHEN lower(name) = 'doc-11' THEN 0 WHEN starts_with(lower(name), 'doc-11') THEN 1 ELSE 2 END, length(name), lower(name), lower(path) LIMIT 5""")
def trigram_order(spark, sf):
    terms = ["doc-11", "log"]
    found = views.catalog(spark, sf).where(S.has_trigrams(terms) & S.has_substrings(terms))
    return S.page(found, S.trigram_order(terms), 0, 5).select("doc_id")


# --- sets -------------------------------------------------------------------


@query("st_01_append_page", rf"""WITH s AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'C:\Logs\U'||user_id ELSE 'c:/logs/u'||user_id END AS path FROM events),
k AS (SELECT lower(replace(path, '/', '\')) AS key, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS side, event_id, path FROM s),
first AS (SELECT DISTINCT ON (key) path, side, event_id FROM k ORDER BY key, side, event_id)
SELECT event_id, path FROM first ORDER BY side, event_id LIMIT 1000""")
def append_page(spark, sf):
    rows = _respelled(spark, sf)
    merged = S.merge_pages(rows.where(C("event_id") % 5 == 0), rows.where(C("event_id") % 5 != 0), "event_id", MAX_KEPT_RESULTS)
    return merged.select("event_id", "path")


@query("st_02_minimal_roots", rf"""WITH {DOC_ROOTS}
SELECT root FROM doc_roots r WHERE NOT EXISTS (SELECT 1 FROM doc_roots o WHERE starts_with(r.root, o.root||'/'))""")
def minimal_roots(spark, sf):
    return R.minimal_roots(_doc_roots(spark, sf))


@query("st_03_add_root", rf"""WITH {DOC_ROOTS}
SELECT root, false AS added FROM doc_roots WHERE NOT starts_with(root, '/data/src2/') AND root <> '/data/src2' UNION ALL SELECT '/data/src2', true""")
def add_root(spark, sf):
    return R.add_root(_doc_roots(spark, sf), "/data/src2")


@query("st_03_add_covered_root", rf"""WITH {DOC_ROOTS} SELECT root, false AS added FROM doc_roots""")
def add_covered_root(spark, sf):
    return R.add_root(_doc_roots(spark, sf), "/data/src3/zz")


@query("st_04_distinct_spellings", r"""SELECT '/u/'||user_id AS path, min(event_id) AS seq FROM events WHERE event_type <> 'click' GROUP BY user_id""")
def distinct_spellings(spark, sf):
    events = views.table(spark, sf, "events")
    path = F.when(C("event_type") == "click", F.lit("  ")).otherwise(F.concat(F.lit("  /u/"), C("user_id").cast("string"), F.lit(" ")))
    return R.distinct_paths(events.select(path.alias("path"), C("event_id").alias("seq")), "path", "seq")


@query("st_05_batch_paths", rf"""WITH {D.FILE_EVENTS} SELECT DISTINCT path FROM file_events""")
def batch_paths(spark, sf):
    return views.file_events(spark, sf).select("path").distinct()


ARRIVAL_OPS = r"""words AS (
 SELECT seq, 0 AS pos, path, 'schedule' AS action FROM file_events WHERE op = 'create' OR (op IN ('modify', 'rename_unpaired') AND present)
 UNION ALL SELECT seq, 0, path, 'cancel' FROM file_events WHERE op = 'remove' OR (op IN ('modify', 'rename_unpaired') AND NOT present)
 UNION ALL SELECT seq, 0, old_path, 'cancel' FROM file_events WHERE op = 'rename'
 UNION ALL SELECT seq, 1, path, 'schedule' FROM file_events WHERE op = 'rename')"""


@query("st_06_schedule_and_cancel", rf"""WITH {D.FILE_EVENTS}, {ARRIVAL_OPS}
SELECT path, arg_max(action, seq * 2 + pos) AS action FROM words GROUP BY path""")
def schedule_and_cancel(spark, sf):
    return H.normalize_arrivals(views.file_events(spark, sf))


@query("st_07_remove_subtree", rf"""WITH {D.CATALOG} SELECT doc_id FROM catalog WHERE source <> 'src4' AND NOT (source = 'src5' AND lang = 'en')""")
def remove_subtree(spark, sf):
    return R.without_subtree(views.files(spark, sf), ["/data/src4", "/data/src5/en"]).select("doc_id")


@query("st_08_union_of_tokens", rf"""WITH {D.SPELLINGS}
SELECT doc_id, string_agg(token, ' ' ORDER BY token) AS tokens FROM (
 SELECT DISTINCT doc_id, unnest(TOKENS) AS token FROM spellings) GROUP BY doc_id""".replace("TOKENS", _token_sql("path")))
def union_of_tokens(spark, sf):
    from logquarry.functions.text import name_tokens

    return views.spellings(spark, sf).select("doc_id", F.array_join(F.array_sort(name_tokens(C("path"))), " ").alias("tokens"))
