"""Sources and sinks: scans, line files, containers and versioned tables."""

from pyspark.sql import functions as F

from logquarry.constants import ArchiveLimits
from logquarry.operators import changes as H
from logquarry.operators import lines as L
from logquarry.operators.roots import refreshed_rows, with_root
from logquarry.operators.search import with_search_columns
from logquarry.plans import views
from logquarry.queries import duck as D
from logquarry.queries import derived as P
from logquarry.queries.derived import nested_files
from logquarry.queries.registry import query
from logquarry.session import materialize, work_path
from logquarry.sources import archives as A
from logquarry.sources import files as FS
from logquarry.sources import lineindex as X
from logquarry.sources import textlines as T
from logquarry.sources.snapshots import Snapshots, usable

C = F.col
# Documents written into one text file; the number of files grows with the table.
DOCS_PER_FILE = 250


def doc_number(path: str = "source_path"):
    """Number of the document a derived container was packed from."""
    return F.regexp_extract(F.col(path), r"(\d+)", 1).cast("bigint")


# --- scans ------------------------------------------------------------------

@query("src_02_catalog_row", rf"""WITH {D.CATALOG}
SELECT path, name, CASE WHEN source IN ('src1', 'src7') THEN '/data/'||source ELSE 'none' END AS root, size, CASE WHEN doc_id < 20 THEN -1 ELSE (doc_id - 20) * 123456789 // 1000 END AS modified_ms,
 is_log, is_archive FROM catalog""")
def catalog_row(spark, sf):
    files = views.files(spark, sf).withColumn("modified", F.timestamp_micros((C("doc_id") - 20) * 123_456_789))
    rows = FS.catalog_rows(files, ["/data/src1", "/data/src7"])
    return rows.withColumn("root", F.coalesce("root", F.lit("none"))).withColumn("modified_ms", F.coalesce("modified_ms", F.lit(-1)))


@query("src_03_inventory", rf"""WITH {D.CATALOG}
SELECT '/data/'||lang AS path, lang AS name, 'dir' AS kind, 0 AS size, false AS is_log FROM (SELECT DISTINCT lang FROM documents)
UNION ALL SELECT '/data/'||name, name, CASE WHEN is_archive THEN 'archive' ELSE 'file' END, size, is_archive OR is_log FROM catalog WHERE doc_id % 3 = 0""")
def inventory(spark, sf):
    rows = views.catalog(spark, sf)
    lang = F.element_at(F.split("parent", "/"), -1)
    moved = F.when(C("doc_id") % 3 == 0, F.concat(F.lit("/data/"), "name")).otherwise(F.concat(F.lit("/data/"), lang, F.lit("/x/"), "name"))
    flat = rows.withColumn("path", moved)
    # Every language keeps at least one deeper file.
    deeper = rows.withColumn("path", F.concat(F.lit("/data/"), lang, F.lit("/y/"), "name"))
    return FS.inventory(flat.unionByName(deeper), "/data/")


# --- text files -------------------------------------------------------------


def written_lines(spark, sf):
    """Documents written as text files, many documents one after another."""
    path = work_path(spark, "text_files")
    docs = views.table(spark, sf, "documents").select("doc_id", "text", F.floor(C("doc_id") / DOCS_PER_FILE).alias("bucket"))
    ordered = docs.repartition("bucket").sortWithinPartitions("bucket", "doc_id")
    ordered.select("bucket", "text").write.partitionBy("bucket").option("lineSep", "\n").text(path)
    return path


FILE_ROWS = rf"""pieces AS (SELECT doc_id, doc_id // {DOCS_PER_FILE} AS bucket, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS pos
 FROM (SELECT doc_id, string_split(text, chr(10)) AS pieces FROM documents)),
file_rows AS (SELECT bucket, row_number() OVER (PARTITION BY bucket ORDER BY doc_id, pos) AS line_no, rtrim(piece, chr(13)||chr(10)) AS content,
 octet_length(encode(piece)) + 1 AS raw_len FROM pieces)"""


def _bucketed(lines):
    return lines.withColumn("bucket", F.regexp_extract("path", r"bucket=(\d+)", 1).cast("bigint"))


@query("src_04_text_lines", rf"""WITH {FILE_ROWS} SELECT bucket, line_no, content, raw_len, false AS truncated FROM file_rows""")
def text_lines(spark, sf):
    lines = T.read_lines(spark, written_lines(spark, sf))
    return _bucketed(lines).select("bucket", "line_no", "content", "raw_len", "truncated")


@query("sr_06_indexed_range", rf"""WITH {FILE_ROWS}
SELECT bucket, line_no, content, raw_len FROM file_rows WHERE line_no BETWEEN 301 AND 500""")
def indexed_range(spark, sf):
    """200 lines of every file, read through the stored line index."""
    index = X.index_lines(spark, written_lines(spark, sf), every=100)
    return _bucketed(X.indexed_range(index, 300, 200)).select("bucket", "line_no", "content", "raw_len")


@query("wn_02_indexed_spans", rf"""WITH {FILE_ROWS}, starts AS (
 SELECT bucket, line_no, raw_len, count(*) OVER (PARTITION BY bucket) AS n_lines,
  coalesce(sum(raw_len) OVER (PARTITION BY bucket ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS byte_start FROM file_rows)
SELECT bucket, line_no - 1 AS line, CAST(byte_start AS BIGINT) AS byte_start, n_lines FROM starts WHERE (line_no - 1) % 100 = 0""")
def indexed_spans(spark, sf):
    """Where every hundredth line of every file begins."""
    index = X.index_lines(spark, written_lines(spark, sf), every=100, span_bytes=1 << 30, range_bytes=1 << 30)
    return _bucketed(index.where("lines > 0")).select("bucket", "line", C("offset").alias("byte_start"), "n_lines")


@query("fn_05_wide_lines", rf"""WITH {FILE_ROWS} SELECT bucket, line_no, content FROM file_rows""")
def wide_lines(spark, sf):
    """Documents written as UTF-16 files, read in many splits."""
    files = P.wide_text_files(spark, sf, DOCS_PER_FILE)
    index = materialize(X.index_files(files, range_bytes=1 << 16, span_bytes=1 << 14), "wide_index")
    return _bucketed(X.indexed_lines(index)).select("bucket", "line_no", "content")


@query("src_01_scan", f"""SELECT doc_id // {DOCS_PER_FILE} AS bucket, true AS is_log, false AS is_archive,
 CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS size, true AS has_mtime FROM documents WHERE doc_id // {DOCS_PER_FILE} <> 1 GROUP BY ALL""")
def scan(spark, sf):
    """Files written from the documents, but for those below an excluded directory."""
    folder = written_lines(spark, sf)
    # Spark's own files begin with a dot or an underscore.
    rows = _bucketed(FS.scan(spark, [folder], [f"{folder}/bucket=1"]).where(~C("name").rlike("^[._]")))
    return rows.select("bucket", "is_log", "is_archive", "size", (C("modified_ms") > 0).alias("has_mtime"))


# --- containers -------------------------------------------------------------

ENTRY_COLUMNS = """SELECT doc_id, 'logs/doc-'||doc_id||'.log' AS entry_path, octet_length(encode(text)) AS size, true AS is_log, false AS encrypted FROM documents
UNION ALL SELECT doc_id, 'assets/image.bin', 4, false, false FROM documents
UNION ALL SELECT doc_id, '日志/服务.txt', 8, true, false FROM documents"""


def _listed(spark, sf, formats):
    listed = A.entries(A.start_level(P.packed_files(spark, sf, formats)))
    return listed.withColumn("doc_id", doc_number())


@query("src_05_zip_entries", ENTRY_COLUMNS + " UNION ALL SELECT doc_id, 'secret.log', 6, false, true FROM documents")
def zip_entries(spark, sf):
    return _listed(spark, sf, P.ZIPS).select("doc_id", "entry_path", "size", "is_log", "encrypted")


@query("src_06_tar_entries", ENTRY_COLUMNS)
def tar_entries(spark, sf):
    return _listed(spark, sf, P.TARS).select("doc_id", "entry_path", "size", "is_log", "encrypted")


@query("src_07_stream_entries", """SELECT doc_id, 'doc-'||doc_id||'.log' AS entry_path, true AS is_log, true AS sized FROM documents""")
def stream_entries(spark, sf):
    listed = _listed(spark, sf, P.STREAMS)
    return listed.select("doc_id", "entry_path", "is_log", (C("size") > 0).alias("sized"))


@query("src_08_plain_entries", """SELECT doc_id, 'doc-'||doc_id||'.log' AS entry_path, octet_length(encode(text)) AS size, true AS is_log FROM documents""")
def plain_entries(spark, sf):
    return _listed(spark, sf, P.PLAIN).select("doc_id", "entry_path", "size", "is_log")


LINE_FORMATS = [*P.ZIPS, *P.TARS, *P.STREAMS, *P.PLAIN]


@query("src_09_entry_lines", rf"""WITH {D.LINES}
SELECT doc_id, CASE WHEN doc_id % 11 <= 5 THEN 'logs/doc-'||doc_id||'.log' ELSE 'doc-'||doc_id||'.log' END AS entry_path, line_no, content, false AS truncated
FROM file_lines
UNION ALL SELECT doc_id, '日志/服务.txt', unnest([1, 2]), unnest(['one', 'two']), false FROM documents WHERE doc_id % 11 <= 5""")
def entry_lines(spark, sf):
    lines = A.entry_lines(A.start_level(P.packed_files(spark, sf, LINE_FORMATS)))
    return lines.select(doc_number().alias("doc_id"), "entry_path", "line_no", "content", "truncated")


@query("src_10_nested_entries", """
SELECT doc_id, 'nested/diag.tar' AS chain, 'logs/server.log' AS entry_path, octet_length(encode(text)) AS size, 'none' AS error FROM documents
UNION ALL SELECT doc_id, 'deeper.tar.gz::inner.zip', 'inside.log', 7, 'none' FROM documents
UNION ALL SELECT doc_id, 'deeper.tar.gz', 'inner.zip', -1, 'none' FROM documents
UNION ALL SELECT doc_id, '', unnest(['nested/diag.tar', 'deeper.tar.gz', 'fake.tar', 'top.log']), -1, 'none' FROM documents
UNION ALL SELECT doc_id, 'fake.tar', 'none', -1, 'entry content is not an archive' FROM documents""")
def nested_entries(spark, sf):
    rows = A.all_entries(nested_files(spark, sf))
    sized = C("entry_path").isin("logs/server.log", "inside.log")
    return rows.select(
        doc_number().alias("doc_id"),
        F.array_join("chain", "::").alias("chain"),
        F.coalesce("entry_path", F.lit("none")).alias("entry_path"),
        F.when(sized, C("size")).otherwise(F.lit(-1)).alias("size"),
        F.coalesce("error", F.lit("none")).alias("error"),
    )


@query("src_10_nested_lines", rf"""WITH {D.LINES}
SELECT doc_id, 'nested/diag.tar' AS chain, 'logs/server.log' AS entry_path, line_no, content FROM file_lines
UNION ALL SELECT doc_id, 'deeper.tar.gz::inner.zip', 'inside.log', 1, 'inside' FROM documents
UNION ALL SELECT doc_id, '', 'top.log', 1, 'top' FROM documents
UNION ALL SELECT doc_id, 'fake.tar', 'none', -1, 'entry content is not an archive' FROM documents""")
def nested_lines(spark, sf):
    lines = A.nested_lines(nested_files(spark, sf))
    return lines.select(
        doc_number().alias("doc_id"),
        F.array_join("chain", "::").alias("chain"),
        F.coalesce("entry_path", F.lit("none")).alias("entry_path"),
        F.coalesce("line_no", F.lit(-1)).alias("line_no"),
        F.coalesce("content", "error").alias("content"),
    )


@query("jn_14_open_nested_entry", rf"""WITH {D.LINES} SELECT doc_id, line_no, content FROM file_lines""")
def open_nested_entry(spark, sf):
    """One entry of a container within a container, alone."""
    lines = A.lines_of_entry(nested_files(spark, sf), ["nested/diag.tar", "logs/server.log"])
    return lines.select(doc_number().alias("doc_id"), "line_no", "content")


@query("ag_04_entries_per_archive", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 4 ELSE 3 END AS n_entries, doc_id % 6 <> 0 AS within_limit FROM documents")
def entries_per_archive(spark, sf):
    counts = A.entry_counts(_listed(spark, sf, [*P.ZIPS, *P.TARS]), 3)
    return counts.select(doc_number().alias("doc_id"), "n_entries", "within_limit")


@query("ag_05_decoded_bytes_limit", """SELECT doc_id, CASE WHEN octet_length(encode(text)) > 5000 THEN 'decoded size limit exceeded' ELSE 'none' END AS error FROM documents""")
def decoded_limit(spark, sf):
    files = P.packed_files(spark, sf, [*P.STREAMS, *P.PLAIN])
    # Documents with one id are files of one name, told apart by the place.
    files = files.withColumn("path", F.concat(F.substring_index("place", "/", -1), "path"))
    lines = A.entry_lines(A.start_level(files), ArchiveLimits(max_decoded_bytes=5000))
    # A file without lines has its row as well.
    every = files.select(C("path").alias("source_path"), "doc_id", F.lit(None).cast("string").alias("error"))
    every = every.unionByName(lines.select("source_path", F.lit(None).cast("bigint").alias("doc_id"), "error"))
    worst = every.groupBy("source_path").agg(F.max("doc_id").alias("doc_id"), F.max("error").alias("error"))
    return worst.select("doc_id", F.coalesce("error", F.lit("none")).alias("error"))


@query("jn_14_entry_lookup", """SELECT doc_id, want AS entry_path, CASE WHEN want = 'absent.log' THEN 'missing' WHEN want = 'secret.log' THEN 'encrypted' WHEN want = 'assets/image.bin' THEN 'not a log' ELSE 'none' END AS error
FROM (SELECT doc_id, unnest(['absent.log', 'secret.log', 'assets/image.bin', '日志/服务.txt']) AS want FROM documents)""")
def entry_lookup(spark, sf):
    files = P.packed_files(spark, sf, P.ZIPS)
    listed = A.entries(A.start_level(files))
    wants = F.array(*[F.lit(w) for w in ("absent.log", "secret.log", "assets/image.bin", "日志/服务.txt")])
    requests = files.select(C("path").alias("source_path"), F.explode(wants).alias("entry_path"))
    found = A.lookup_entries(requests, listed)
    return found.select(doc_number().alias("doc_id"), "entry_path", F.coalesce("error", F.lit("none")).alias("error"))


# --- node and journal sources -----------------------------------------------


@query("src_11_node_snapshot", rf"""WITH {D.NODES} SELECT id, parent_id, name, attributes, seq FROM nodes""")
def node_snapshot(spark, sf):
    return materialize(views.nodes(spark, sf), "node_snapshot")


JOURNAL_STATE = r"""state AS (SELECT '/v'||(id % 5) AS root, max(seq) AS last, count(*) AS n FROM journal GROUP BY id % 5)"""


def journal_with_root(spark, sf):
    return views.journal(spark, sf).withColumn("root", F.concat(F.lit("/v"), (C("id") % 5).cast("string")))


def journal_positions(spark, sf):
    """Saved positions and what the journals say now, one of five roots stale."""
    last = journal_with_root(spark, sf).groupBy("root").agg(F.max("seq").alias("last"))
    state = last.select(
        "root", F.lit("vol").alias("identity"), F.when(C("root") == "/v1", F.lit("old")).otherwise(F.lit("j")).alias("journal_id"),
        F.floor(C("last") / 2).alias("next_seq"), (C("root") != "/v3").alias("complete"),
    )
    info = last.select(
        "root", F.lit("vol").alias("identity"), F.lit("j").alias("journal_id"),
        F.when(C("root") == "/v2", C("last")).otherwise(F.lit(0)).alias("first_seq"), (C("last") + 1).alias("next_seq"),
    )
    return state, info


@query("src_12_journal_records", rf"""WITH {D.JOURNAL}, {JOURNAL_STATE}
SELECT root, seq, id FROM (SELECT '/v'||(id % 5) AS root, seq, id FROM journal) JOIN state USING (root)
WHERE root IN ('/v0', '/v4') AND seq >= last // 2 AND seq <= last""")
def journal_records(spark, sf):
    plan = H.resume_plan(*journal_positions(spark, sf))
    records, _ = H.catch_up_records(journal_with_root(spark, sf), plan)
    return records.select("root", "seq", "id")


# --- sinks ------------------------------------------------------------------


def _bumped(rows):
    """Changed and new rows: every third path, and copies of every fifth."""
    changed = rows.where(C("doc_id") % 3 == 0).withColumn("size", C("size") + 1)
    added = rows.where(C("doc_id") % 5 == 0).withColumn("path", F.concat("path", F.lit(".new")))
    return changed.unionByName(added)


@query("snk_01_upsert", rf"""WITH {D.CATALOG}
SELECT path, CASE WHEN doc_id % 3 = 0 THEN size + 1 ELSE size END AS size FROM catalog UNION ALL SELECT path||'.new', size FROM catalog WHERE doc_id % 5 = 0""")
def upsert(spark, sf):
    rows = views.files(spark, sf)
    store = Snapshots(spark, work_path(spark, "upserted"), rows.schema)
    store.replace(rows)
    store.replace(H.upsert(store.read(), _bumped(rows)))
    return store.read().select("path", "size")


@query("snk_02_insert_absent", rf"""WITH {D.CATALOG}
SELECT path, size FROM catalog UNION ALL SELECT path||'.new', size FROM catalog WHERE doc_id % 5 = 0""")
def insert_absent(spark, sf):
    rows = views.files(spark, sf)
    return H.insert_absent(rows, _bumped(rows)).select("path", "size")


@query("snk_03_replace_root", rf"""WITH {D.CATALOG}
SELECT path, source AS root_key, CASE WHEN source = 'src4' THEN size + 7 ELSE size END AS size FROM catalog WHERE source <> 'src4' OR doc_id % 2 = 0""")
def replace_root(spark, sf):
    rows = views.files(spark, sf).select("path", "size", F.element_at(F.split("path", "/"), 3).alias("root_key"), "doc_id")
    table = rows.select("path", "size", "root_key")
    store = Snapshots(spark, work_path(spark, "by_root"), table.schema, ["root_key"])
    store.replace(table)
    fresh = rows.where((C("root_key") == "src4") & (C("doc_id") % 2 == 0)).withColumn("size", C("size") + 7)
    store.replace_where(C("root_key") == "src4", fresh)
    return store.read()


@query("snk_03_emptied_root", rf"""WITH {D.CATALOG} SELECT 'after' AS stage, path, source AS root FROM catalog WHERE source <> 'src4'
UNION ALL SELECT 'before', path, source FROM catalog""")
def emptied_root(spark, sf):
    """A refresh that finds no file leaves no row of the root; readers of the old version see it whole."""
    rows = views.files(spark, sf).select("path", F.element_at(F.split("path", "/"), 3).alias("root"))
    store = Snapshots(spark, work_path(spark, "emptied"), rows.schema, ["root"])
    store.replace(rows)
    before = store.read()
    store.replace_where(C("root") == "src4", rows.limit(0))
    stages = [part.select(F.lit(stage).alias("stage"), "path", "root") for stage, part in (("before", before), ("after", store.read()))]
    return stages[0].unionByName(stages[1])


@query("snk_03_nested_roots", rf"""WITH {D.CATALOG}
SELECT path, CASE WHEN source = 'src1' AND lang = 'en' THEN '/data/src1/en' ELSE '/data/src1' END AS root, size + CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS size
FROM catalog WHERE source = 'src1'""")
def nested_roots(spark, sf):
    """Refreshing a root leaves the files of a root inside it with that one, each listed once."""
    rows = with_root(views.files(spark, sf).select("path", "size"), ["/data/src1", "/data/src1/en"]).where("root IS NOT NULL")
    store = Snapshots(spark, work_path(spark, "nested_roots"), rows.schema, ["root"])
    store.replace(rows)
    found = views.files(spark, sf).where(F.startswith("path", F.lit("/data/src1/"))).select("path", (C("size") + 1).alias("size"))
    fresh = refreshed_rows(store.read(), found.withColumn("root", F.lit("/data/src1")), "/data/src1")
    store.replace_where(C("root") == "/data/src1", fresh)
    return store.read()


@query("snk_04_rebuild_and_switch", rf"""WITH {D.CATALOG}
SELECT 'during' AS stage, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM catalog
UNION ALL SELECT 'after', count(*), CAST(sum(size + 1) AS BIGINT) FROM catalog WHERE doc_id % 2 = 1
UNION ALL SELECT 'recovered', count(*), CAST(sum(size + 1) AS BIGINT) FROM catalog WHERE doc_id % 2 = 1""")
def rebuild_and_switch(spark, sf):
    rows = views.files(spark, sf)
    store = Snapshots(spark, work_path(spark, "switched"), rows.schema)
    store.replace(rows)

    def facts(stage):
        return store.read().agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).select(F.lit(stage).alias("stage"), "n", "bytes")

    built = store.build(rows.where(C("doc_id") % 2 == 1).withColumn("size", C("size") + 1))
    during = facts("during")
    store.switch(built)
    after = facts("after")
    # A build that never switched is not seen, even by a new reader.
    store.build(rows)
    return during.unionByName(after).unionByName(facts("recovered"))


@query("snk_05_clear_and_delete", rf"""WITH {D.CATALOG} SELECT 'deleted' AS stage, path FROM catalog WHERE doc_id % 4 <> 2""")
def clear_and_delete(spark, sf):
    rows = views.files(spark, sf)
    store = Snapshots(spark, work_path(spark, "cleared"), rows.schema)
    store.replace(rows)
    kept = H.delete_keys(store.read(), rows.where(C("doc_id") % 4 == 2))
    deleted = kept.select(F.lit("deleted").alias("stage"), "path")
    store.clear()
    return deleted.unionByName(store.read().select(F.lit("cleared").alias("stage"), "path"))


@query("snk_06_journal_state", rf"""WITH {D.JOURNAL}, {JOURNAL_STATE} SELECT root, 'vol' AS identity, last + 1 AS next_seq, root <> '/v3' AS complete FROM state""")
def journal_state(spark, sf):
    state, info = journal_positions(spark, sf)
    columns = state.select("root", "identity", "next_seq", "complete")
    store = Snapshots(spark, work_path(spark, "positions"), columns.schema)
    store.replace(columns)
    moved = info.select("root", "next_seq").join(columns.drop("next_seq"), "root").select(*columns.columns)
    store.replace(H.upsert(store.read(), moved, "root"))
    return store.read()


@query("snk_07_export_lines", rf"""WITH {FILE_ROWS}, t AS (SELECT bucket, string_agg(piece, chr(10) ORDER BY doc_id, pos) || chr(10) AS whole FROM pieces GROUP BY bucket),
c AS (SELECT bucket, count(*) AS n, count(*) FILTER (line_no <= 300) AS n_lines FROM file_rows GROUP BY bucket),
p AS (SELECT bucket, string_agg(piece || chr(10), '' ORDER BY doc_id, pos) AS part FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id, pos) AS k FROM pieces) WHERE k <= 300 GROUP BY bucket)
SELECT bucket, n_lines, CAST(octet_length(encode(part)) AS BIGINT) AS bytes, n <= 300 AS complete, sha256(part) AS digest FROM c JOIN p USING (bucket)""")
def export_lines(spark, sf):
    """The first 300 lines of each file, and the digest of what stands in the copy."""
    lines = T.read_lines(spark, written_lines(spark, sf))
    facts = L.export_lines(lines, 300, work_path(spark, "export"))
    copies = spark.read.format("binaryFile").load([f"{facts.first().target.rpartition('/')[0]}"])
    written = copies.select(T.plain_path(C("path")).alias("target"), F.sha2("content", 256).alias("digest"))
    facts = facts.withColumn("target", T.plain_path(C("target")))
    return _bucketed(facts).join(written, "target").select("bucket", "n_lines", "bytes", "complete", "digest")


@query("snk_08_rebuild_search_columns", rf"""SELECT count(*) AS n_catalog, count(*) AS n_derived, true AS usable FROM documents""")
def rebuild_search_columns(spark, sf):
    rows = views.catalog(spark, sf)
    derived = materialize(with_search_columns(rows), "search_columns")
    return usable(rows, derived, False)
