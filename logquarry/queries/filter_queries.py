"""Classification and filter predicates over whole tables."""

from pyspark.sql import functions as F

from logquarry.constants import MAX_FILE_BYTES
from logquarry.functions import classify as K
from logquarry.functions.paths import comparable, within
from logquarry.operators import search as S
from logquarry.operators.roots import without_excluded, without_platform_directories
from logquarry.plans import views
from logquarry.queries import duck as D
from logquarry.queries import derived as P
from logquarry.queries.derived import tar_headers, zip_listing
from logquarry.queries.path_queries import EXCLUSIONS
from logquarry.queries.registry import query
from logquarry.session import work_path
from logquarry.sources import archives as A
from logquarry.sources.postings import Postings
from logquarry.sources.textlines import split_by_limit

C = F.col

ENDINGS = [
    ".log", ".TXT", ".out", ".err", ".trace", ".json", ".CSV", ".bin", ".tar.bz2", ".tar.zst", ".TAR.gz", ".tar.xz",
    ".tbz2", ".tzst", ".tgz", ".tbz", ".txz", ".Zip", ".7z", ".rar", ".tar", ".gz", ".bz2", ".xz", ".zst", ".", "",
]
FORMATS = [
    "tar.bz2", "tar.zst", "tar.gz", "tar.xz", "tar.bz2", "tar.zst", "tar.gz", "tar.bz2", "tar.xz",
    "zip", "7z", "rar", "tar", "gz", "bz2", "xz", "zst",
]


def _names(spark, sf):
    docs = views.table(spark, sf, "documents")
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (C("doc_id") % len(ENDINGS) + 1).cast("int"))
    return docs.select("doc_id", F.concat(F.lit("f"), C("doc_id").cast("string"), ending).alias("name"))


@query("flt_01_is_log_name", f"SELECT doc_id, doc_id % {len(ENDINGS)} < 7 AS is_log FROM documents")
def is_log_name(spark, sf):
    return _names(spark, sf).select("doc_id", K.is_log_name(C("name")).alias("is_log"))


@query("flt_02_archive_format", f"""SELECT doc_id, CASE doc_id % {len(ENDINGS)}
 {' '.join(f"WHEN {i + 8} THEN '{fmt}'" for i, fmt in enumerate(FORMATS))} ELSE 'none' END AS format FROM documents""")
def archive_format(spark, sf):
    fmt = F.coalesce(K.archive_format_by_name(C("name")), F.lit("none"))
    return _names(spark, sf).select("doc_id", fmt.alias("format"))


MAGIC_FORMATS = [*P.ZIPS, *P.TARS, *P.STREAMS, *P.PLAIN, *P.FOREIGN]
SHOWN = ["plain" if f == "log" else f.removeprefix("log.") for f in MAGIC_FORMATS]


@query("flt_03_magic_format", f"""SELECT doc_id, ['{"', '".join(SHOWN)}'][doc_id % {len(SHOWN)} + 1] AS format FROM documents""")
def magic_format(spark, sf):
    return A.with_format(P.packed_files(spark, sf, MAGIC_FORMATS)).select("doc_id", "format")


@query("flt_04_tar_header", "SELECT doc_id, doc_id % 4 < 2 AS is_tar FROM documents")
def tar_header(spark, sf):
    return tar_headers(spark, sf).select("doc_id", K.is_tar_header(C("content")).alias("is_tar"))


def _samples(spark, sf):
    text = F.encode("text", "UTF-8")
    kind = C("doc_id") % 4
    content = (
        F.when(kind == 0, text)
        .when(kind == 1, F.concat(F.unhex(F.lit("00")), text))
        .when(kind == 2, F.concat(F.unhex(F.lit("01" * 500)), text))
        .otherwise(F.unhex(F.lit("")))
    )
    docs = views.table(spark, sf, "documents")
    return docs.select("doc_id", content.alias("content"))


@query("flt_05_text_sample", "SELECT doc_id, doc_id % 4 IN (0, 3) AS is_text FROM documents")
def text_sample(spark, sf):
    return _samples(spark, sf).select("doc_id", K.is_text_sample(C("content")).alias("is_text"))


@query("flt_06_arrival_kind", """SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'archive' ELSE 'file' END AS kind FROM documents
 WHERE doc_id % 3 = 2 OR doc_id % 4 IN (0, 3) OR doc_id % 5 = 1""")
def arrival_kind(spark, sf):
    rows = _samples(spark, sf)
    rows = rows.withColumn("content", F.when(C("doc_id") % 3 == 2, F.concat(F.unhex(F.lit("504B0304")), "content")).otherwise(C("content")))
    name = F.when(C("doc_id") % 5 == 1, F.lit("server.LOG")).otherwise(F.lit("notes.data"))
    fmt = K.detect_format(C("content"), name)
    kinds = rows.select("doc_id", K.arrival_kind(C("content"), name, fmt).alias("kind"))
    return kinds.where(C("kind").isNotNull())


@query("flt_07_safe_entry_name", "SELECT doc_id, doc_id % 10 IN (0, 1, 9) AS safe FROM documents")
def safe_entry(spark, sf):
    number = C("doc_id").cast("string")
    shapes = ["logs/a{}.log", "日志/服务{}.txt", "../out{}.log", "C:\\out{}.log", "/abs{}.log", "\\abs{}.log", "a::b{}", "a/../b{}", "x{}", "a..b/c{}"]
    built = F.element_at(F.array(*[F.lit(s) for s in shapes]), (C("doc_id") % 10 + 1).cast("int"))
    name = F.when(C("doc_id") % 10 == 8, F.repeat(F.lit("日"), 1400)).otherwise(F.replace(built, F.lit("{}"), number))
    docs = views.table(spark, sf, "documents")
    return docs.select("doc_id", K.is_safe_entry(name, 4096).alias("safe"))


@query("flt_08_notification_filter", rf"""WITH {D.CATALOG}
SELECT doc_id, doc_id % 10 IN (0, 1, 2, 5, 7, 8, 9) AS default_set, true AS show_all FROM catalog""")
def notification_filter(spark, sf):
    rows = views.catalog(spark, sf)
    return rows.select(
        "doc_id",
        K.passes_filter(C("name"), C("is_archive"), [".LOG", ".txt", ".out"]).alias("default_set"),
        K.passes_filter(C("name"), C("is_archive"), [], True).alias("show_all"),
    )


@query("flt_09_arrival_prefilter", f"SELECT doc_id FROM documents WHERE doc_id % {len(ENDINGS)} < 2 OR doc_id % {len(ENDINGS)} BETWEEN 8 AND 24")
def arrival_prefilter(spark, sf):
    names = _names(spark, sf)
    return names.where(K.passes_filter(C("name"), K.is_archive_name(C("name")), [".log", ".txt"])).select("doc_id")


@query("flt_10_within_root", rf"""WITH {D.SPELLINGS}
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source = 'src1' WHEN 3 THEN source = 'src1' WHEN 4 THEN source = 'src1' ELSE false END AS inside FROM spellings""")
def within_root(spark, sf):
    key = comparable(C("path"))
    hit = within(key, comparable(F.lit("/data/src1"))) | within(key, comparable(F.lit("c:/DATA/src1/")))
    return views.spellings(spark, sf).select("doc_id", hit.alias("inside"))


@query("flt_11_exclusion", rf"""WITH {D.CATALOG}
SELECT doc_id, path FROM catalog WHERE NOT (source = 'src3' OR (source = 'src9' AND lang = 'fr'))""")
def exclusion(spark, sf):
    return without_excluded(views.files(spark, sf), EXCLUSIONS).select("doc_id", "path")


@query("flt_12_platform_directories", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def platform_directories(spark, sf):
    prefix = F.when(C("doc_id") % 6 == 0, F.lit("/Volumes")).when(C("doc_id") % 6 == 3, F.lit("/dev")).when(
        C("doc_id") % 6 == 1, F.lit("/developer")
    ).otherwise(F.lit("/Users"))
    rows = views.files(spark, sf).withColumn("path", F.concat(prefix, "path"))
    return without_platform_directories(rows).select("doc_id")


@query("flt_13_type_filter", rf"""WITH {D.CATALOG}
SELECT 'log' AS filter, doc_id FROM catalog WHERE is_log AND NOT is_archive UNION ALL
SELECT 'archive', doc_id FROM catalog WHERE is_archive UNION ALL SELECT 'other', doc_id FROM catalog""")
def type_filter(spark, sf):
    rows = views.catalog(spark, sf)
    # One scan: each row says which filters keep it.
    kept = F.filter(
        F.array(*[F.when(S.type_filter(name), F.lit(name)) for name in ("log", "archive", "other")]), lambda x: x.isNotNull()
    )
    return rows.select(F.explode(kept).alias("filter"), "doc_id")


@query("flt_14_substring_match", rf"""WITH {D.CATALOG}
SELECT doc_id, path FROM catalog WHERE contains(lower(name||' '||path), 'src1/') AND contains(lower(name||' '||path), '-1')""")
def substring_match(spark, sf):
    return views.catalog(spark, sf).where(S.has_substrings(["src1/", "-1"])).select("doc_id", "path")


@query("flt_15_token_match", rf"""WITH {D.CATALOG} SELECT doc_id, name FROM catalog WHERE doc_id % 10 = 1""")
def token_match(spark, sf):
    return views.catalog(spark, sf).where(S.has_tokens(["doc", "tar", "gz"])).select("doc_id", "name")


@query("flt_15_no_tokens", rf"""WITH {D.CATALOG} SELECT doc_id, 'doc' AS query FROM catalog""")
def no_tokens(spark, sf):
    """Queries of punctuation alone, or of one overlong word, find nothing; a word that all names hold finds all."""
    rows = views.catalog(spark, sf)
    out = S.matching(rows, "doc").select("doc_id", F.lit("doc").alias("query"))
    for text in (".", "-", "()", '"', "!!", "x" * 45):
        out = out.unionByName(S.matching(rows, text).select("doc_id", F.lit(text).alias("query")))
    return out


def _posted(spark, sf):
    """The catalog, and its posting lists: a base without some rows and with some that are gone, then a delta."""
    rows = views.catalog(spark, sf)
    lists = Postings(spark, work_path(spark, "postings"), rows.schema)
    older = rows.where(C("doc_id") % 3 != 0).withColumn("name", F.when(C("doc_id") % 7 == 0, "old.tar.gz").otherwise(C("name")))
    stray = older.where(C("doc_id") % 5 == 0).withColumn("path", F.concat("path", F.lit(".gone")))
    lists.build(older.unionByName(stray), 0)
    lists.add(rows.where((C("doc_id") % 3 == 0) | (C("doc_id") % 7 == 0)), stray.select("path"), 1)
    return rows, lists


@query("flt_15_posting_lists", rf"""WITH {D.CATALOG} SELECT doc_id, name FROM catalog WHERE doc_id % 10 = 1""")
def posting_lists(spark, sf):
    rows, lists = _posted(spark, sf)
    return lists.matching("doc.tar gz", None, rows).select("doc_id", "name")


@query("jn_07_posted_grams", rf"""WITH {D.CATALOG} SELECT doc_id, path FROM catalog WHERE contains(path, 'src11/en')""")
def posted_grams(spark, sf):
    rows, lists = _posted(spark, sf)
    return lists.matching("src11/en", None, rows).select("doc_id", "path")


@query("flt_16_search_choice", rf"""WITH {D.CATALOG}
SELECT doc_id FROM catalog WHERE contains(path, '/data/src7/') AND doc_id % 10 IN (7, 8, 9)
UNION ALL SELECT doc_id FROM catalog WHERE doc_id % 10 = 0""")
def search_choice(spark, sf):
    rows = views.catalog(spark, sf)
    return S.matching(rows, "SRC7/ .log").select("doc_id").unionAll(S.matching(rows, "zip doc").select("doc_id"))


@query("flt_17_trigram_candidates", rf"""WITH {D.CATALOG}
SELECT doc_id FROM catalog WHERE contains(lower(name||' '||path), 'src1/fr') AND contains(lower(name||' '||path), '.tar')""")
def trigram_candidates(spark, sf):
    terms = ["src1/fr", ".tar"]
    return views.catalog(spark, sf).where(S.has_trigrams(terms) & S.has_substrings(terms)).select("doc_id")


@query("flt_18_regular_entries", """SELECT doc_id, entry_path FROM (
 SELECT doc_id, unnest(['logs/doc-'||doc_id||'.log', 'assets/image.bin', '日志/服务.txt']) AS entry_path FROM documents)
 UNION ALL SELECT doc_id, 'secret.log' FROM documents WHERE doc_id % 6 = 0""")
def regular_entries(spark, sf):
    files = P.packed_files(spark, sf, [*P.ZIPS, *P.TARS])
    number = F.regexp_extract("source_path", r"(\d+)", 1).cast("bigint")
    return A.entries(A.start_level(files)).select(number.alias("doc_id"), "entry_path")


@query("flt_19_encrypted_entries", "SELECT doc_id, 'secret.log' AS entry_path, false AS is_log, false AS is_archive FROM documents")
def encrypted_entries(spark, sf):
    return zip_listing(spark, sf).where("encrypted").select("doc_id", "entry_path", "is_log", "is_archive")


@query("flt_20_tree_visibility", rf"""WITH {D.CATALOG}
SELECT doc_id, doc_id % 10 IN (0, 1, 7, 8, 9) OR doc_id = 14 AS visible FROM catalog""")
def tree_visibility(spark, sf):
    rows = views.catalog(spark, sf)
    active = F.concat(C("parent"), F.lit("/doc-14.bin"))
    kind = F.when(C("is_archive"), F.lit("archive")).otherwise(F.lit("file"))
    shown = K.visible_in_tree(C("name"), kind, C("path"), [".log"])
    return rows.select("doc_id", (shown | (C("path") == active)).alias("visible"))


@query("flt_21_browsable_entries", """SELECT doc_id, unnest(['logs/doc-'||doc_id||'.log', '日志/服务.txt']) AS entry_path FROM documents""")
def browsable_entries(spark, sf):
    return A.browsable(zip_listing(spark, sf)).select("doc_id", "entry_path")


@query("flt_22_size_limit", f"""SELECT doc_id, n_chars * doc_id * 1000 AS size, n_chars * doc_id * 1000 > {MAX_FILE_BYTES} AS refused FROM documents""")
def size_limit(spark, sf):
    rows = views.files(spark, sf).select("doc_id", (C("size") * C("doc_id") * 1000).alias("size"))
    kept, refused = split_by_limit(rows)
    return kept.withColumn("refused", F.lit(False)).unionByName(refused.select("doc_id", "size").withColumn("refused", F.lit(True)))


@query("flt_23_blank_query", rf"""WITH {D.CATALOG} SELECT doc_id, path FROM catalog WHERE false""")
def blank_query(spark, sf):
    return S.search(views.catalog(spark, sf), "   ").items.select("doc_id", "path")
