"""Derived path and text columns over whole tables."""

from pyspark.sql import functions as F

from logquarry.functions import paths as P
from logquarry.functions import text as X
from logquarry.functions.classify import content_type, kind
from logquarry.operators.changes import epoch_millis, revision
from logquarry.operators.roots import source_label, with_root
from logquarry.plans import views
from logquarry.queries import duck as D
from logquarry.queries.registry import query

C = F.col
ROOTS = ["/data/src1", "/data/src1/en", "/data/src7"]
EXCLUSIONS = ["/data/src3", "/data/src9/fr"]


def _spelled(spark, sf, **columns):
    return views.spellings(spark, sf).select("doc_id", *[c.alias(n) for n, c in columns.items()])


@query("prj_01_file_name", rf"""WITH {D.SPELLINGS}
SELECT doc_id, regexp_extract(path, '([^/\\]*)$', 1) AS name FROM spellings""")
def file_name(spark, sf):
    return _spelled(spark, sf, name=P.file_name(C("path")))


@query("prj_02_parent", rf"""WITH {D.SPELLINGS}
SELECT doc_id, regexp_replace(path, '[/\\][^/\\]*$', '') AS parent FROM spellings""")
def parent(spark, sf):
    return _spelled(spark, sf, parent=P.parent_dir(C("path")))


@query("prj_03_extension", rf"""WITH {D.SPELLINGS}
SELECT doc_id, lower(regexp_extract(regexp_extract(path, '([^/\\]+)/?$', 1), '^.+\.([^.]*)$', 1)) AS ext FROM spellings""")
def extension(spark, sf):
    trimmed = F.regexp_replace(C("path"), "/$", "")
    return _spelled(spark, sf, ext=P.extension(P.file_name(trimmed)))


@query("prj_04_kind", rf"""WITH {D.CATALOG}
SELECT doc_id, CASE WHEN is_archive THEN 'archive' WHEN is_log THEN 'log' ELSE 'file' END AS kind FROM catalog""")
def kinds(spark, sf):
    return views.catalog(spark, sf).select("doc_id", kind(C("is_log"), C("is_archive")).alias("kind"))


@query("prj_05_content_type", rf"""WITH {D.CATALOG}
SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'application/zip' WHEN 1 THEN 'application/gzip'
  WHEN 4 THEN 'application/octet-stream' WHEN 6 THEN 'application/octet-stream' ELSE 'text/plain' END AS content_type
FROM catalog""")
def content_types(spark, sf):
    return views.catalog(spark, sf).select("doc_id", content_type(C("name")).alias("content_type"))


@query("prj_06_path_key", rf"""WITH {D.SPELLINGS}
SELECT doc_id, CASE WHEN regexp_matches(path, '^[A-Za-z]:[/\\]') THEN lower(replace(path, '/', '\')) ELSE path END AS key
FROM spellings""")
def path_key(spark, sf):
    return _spelled(spark, sf, key=P.path_key(C("path")))


COMPARABLE = r"""CASE WHEN regexp_matches(path, '^[A-Za-z]:[/\\]')
  THEN lower(regexp_replace(regexp_replace(path, '[/\\]+', '/', 'g'), '/$', ''))
  ELSE regexp_replace(regexp_replace(path, '[/\\]+', '/', 'g'), '/$', '') END"""


@query("prj_07_comparable_path", rf"""WITH {D.SPELLINGS} SELECT doc_id, {COMPARABLE} AS comparable FROM spellings""")
def comparable(spark, sf):
    return _spelled(spark, sf, comparable=P.comparable(C("path")))


@query("prj_08_depth", rf"""WITH {D.SPELLINGS}
SELECT doc_id, len(list_filter(string_split_regex(path, '[/\\]'), lambda x: x <> '')) AS depth FROM spellings""")
def depth(spark, sf):
    return _spelled(spark, sf, depth=P.depth(C("path")).cast("bigint"))


@query("prj_09_directory_chain", rf"""WITH {D.SPELLINGS}
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'C:\Data | C:\Data\'||source WHEN 3 THEN '/data | /data/'||source||' | /data/'||source||'/'||lang
  WHEN 4 THEN '/data | /data/'||source ELSE '' END AS chain FROM spellings""")
def directory_chain(spark, sf):
    root = F.when(P.is_windows(C("path")), F.lit("C:\\Data")).otherwise(F.lit("/data"))
    return _spelled(spark, sf, chain=F.array_join(P.directory_chain(root, C("path")), " | "))


@query("prj_10_source_label", rf"""WITH {D.CATALOG}
SELECT doc_id, CASE WHEN source = 'src1' AND lang = 'en' THEN 'en' ELSE source END AS label
FROM catalog WHERE source IN ('src1', 'src7')""")
def labels(spark, sf):
    rooted = with_root(views.files(spark, sf), ROOTS).where(C("root").isNotNull())
    return rooted.select("doc_id", source_label(C("root")).alias("label"))


def _keys(spark, sf):
    base = F.concat(F.lit("/d/"), C("source"), F.lit("/outer-"), C("doc_id").cast("string"), F.lit(".zip"))
    which = C("doc_id") % 3
    key = F.when(which == 0, base).when(which == 1, F.concat(base, F.lit("::logs/app.log"))).otherwise(
        F.concat(base, F.lit("::in/x.tar::a/b.log"))
    )
    return views.table(spark, sf, "documents").select("doc_id", key.alias("key"))


KEYS = r"""keys AS (SELECT doc_id, '/d/'||source||'/outer-'||doc_id||'.zip' AS src, 'outer-'||doc_id||'.zip' AS file FROM documents)"""


@query("prj_11_entry_key_parts", rf"""WITH {KEYS}
SELECT doc_id, src AS source, CASE doc_id % 3 WHEN 0 THEN file WHEN 1 THEN 'app.log' ELSE 'b.log' END AS title,
  CASE doc_id % 3 WHEN 2 THEN src||'::in/x.tar' ELSE src END AS archive,
  CASE doc_id % 3 WHEN 2 THEN 'in/x.tar' ELSE '' END AS chain FROM keys""")
def entry_key_parts(spark, sf):
    return _keys(spark, sf).select(
        "doc_id",
        P.entry_source(C("key")).alias("source"),
        P.entry_title(C("key")).alias("title"),
        P.entry_archive(C("key")).alias("archive"),
        F.array_join(P.entry_chain(C("key")), "::").alias("chain"),
    )


@query("prj_12_breadcrumb", rf"""WITH {KEYS}
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN src WHEN 1 THEN file||' › logs/app.log' ELSE file||' › in/x.tar › a/b.log' END AS crumb
FROM keys""")
def breadcrumb(spark, sf):
    return _keys(spark, sf).select("doc_id", P.breadcrumb(C("key")).alias("crumb"))


SIZES = r"""sizes AS (SELECT doc_id, n_chars * CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 997 WHEN 2 THEN 1000003 ELSE 3 END AS size FROM documents),
scaled AS (SELECT doc_id, size, CASE WHEN size < 1048576 THEN size / 1024.0::DOUBLE WHEN size < 1073741824 THEN size / 1048576.0::DOUBLE
   ELSE size / 1073741824.0::DOUBLE END AS v, CASE WHEN size < 1048576 THEN 'KB' WHEN size < 1073741824 THEN 'MB' ELSE 'GB' END AS unit FROM sizes)"""


@query("prj_13_human_size", rf"""WITH {SIZES}
SELECT doc_id, CASE WHEN size < 1024 THEN size||'B' WHEN v >= 100 THEN CAST(round(v) AS BIGINT)||unit
  ELSE (CAST(round(v * 10) AS BIGINT) // 10)||'.'||(CAST(round(v * 10) AS BIGINT) % 10)||unit END AS shown FROM scaled""")
def human_size(spark, sf):
    factor = F.when(C("doc_id") % 4 == 0, 1).when(C("doc_id") % 4 == 1, 997).when(C("doc_id") % 4 == 2, 1000003).otherwise(3)
    docs = views.table(spark, sf, "documents")
    return docs.select("doc_id", X.human_size(C("n_chars") * factor).alias("shown"))


@query("prj_14_log_level", rf"""WITH {D.LEVELS}
SELECT event_id, coalesce(nullif(regexp_extract(line, '\b(ERROR|WARN|INFO|DEBUG|TRACE|FATAL)\b', 1), ''), 'none') AS level
FROM level_lines""")
def log_level(spark, sf):
    lines = views.level_lines(spark, sf)
    return lines.select("event_id", F.coalesce(X.log_level(C("line")), F.lit("none")).alias("level"))


@query("prj_15_highlight", r"""SELECT doc_id, regexp_replace(text, '(tion|an)', '<mark>\1</mark>', 'gi') AS marked FROM documents""")
def highlight(spark, sf):
    docs = views.table(spark, sf, "documents")
    return docs.select("doc_id", X.highlight(C("text"), " an tion ").alias("marked"))


def _stamped(spark, sf):
    docs = views.table(spark, sf, "documents")
    micros = (C("doc_id") - 20) * 123_456_789
    return docs.select("doc_id", C("n_chars").alias("size"), F.timestamp_micros(micros).alias("modified"))


@query("prj_16_revision", r"""SELECT doc_id, n_chars||':'||CASE WHEN doc_id < 20 THEN 'unknown'
  ELSE ((doc_id - 20) * 123456789 // 1000000)||':'||((doc_id - 20) * 123456789 % 1000000 * 1000) END AS revision FROM documents""")
def revisions(spark, sf):
    return _stamped(spark, sf).select("doc_id", revision(C("size"), C("modified")).alias("revision"))


@query("prj_17_epoch_millis", r"""SELECT doc_id, CASE WHEN doc_id < 20 THEN -1 ELSE (doc_id - 20) * 123456789 // 1000 END AS modified_ms FROM documents""")
def epoch(spark, sf):
    return _stamped(spark, sf).select("doc_id", F.coalesce(epoch_millis(C("modified")), F.lit(-1)).alias("modified_ms"))


@query("prj_18_user_facing_path", rf"""WITH {D.SPELLINGS}
SELECT doc_id, CASE WHEN starts_with(path, '\\?\UNC\') THEN '\\'||substr(path, 9) WHEN starts_with(path, '\\?\') THEN substr(path, 5) ELSE path END AS path
FROM spellings""")
def user_facing(spark, sf):
    return _spelled(spark, sf, path=P.user_facing(C("path")))


# --- text functions ---------------------------------------------------------


def _bytes(spark, sf):
    """Document texts as bytes in five encodings."""
    docs = views.table(spark, sf, "documents")
    kind_ = C("doc_id") % 5
    with X.lenient_charsets(spark):
        return docs.select(
            "doc_id",
            "text",
            F.when(kind_ == 0, F.encode("text", "UTF-8"))
            .when(kind_ == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
            .when(kind_ == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
            .when(kind_ == 3, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")))
            .otherwise(F.concat(F.unhex(F.lit("D6D0CEC4")), F.encode("text", "GB18030")))
            .alias("content"),
        )


@query("fn_01_detect_charset", r"""SELECT doc_id, CASE doc_id % 5 WHEN 2 THEN 'UTF-16LE' WHEN 3 THEN 'UTF-16BE' WHEN 4 THEN 'GB18030' ELSE 'UTF-8' END AS charset
FROM documents""")
def detect_charset(spark, sf):
    return _bytes(spark, sf).select("doc_id", X.detect_charset(C("content")).alias("charset"))


@query("fn_02_decode", r"""SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN '中文'||text ELSE text END AS text FROM documents""")
def decode(spark, sf):
    rows = _bytes(spark, sf).withColumn("charset", X.detect_charset(C("content")))
    with X.lenient_charsets(spark):
        return rows.select("doc_id", X.strip_bom(X.decode_bytes(C("content"), C("charset"))).alias("text"))


@query("fn_03_strip_line_end", r"""SELECT doc_id, rtrim(text, chr(13)||chr(10)) AS text FROM documents""")
def strip_line_end(spark, sf):
    docs = views.table(spark, sf, "documents")
    dressed = F.concat(F.lit("\ufeff"), C("text"), F.when(C("doc_id") % 2 == 0, F.lit("\r\n")).otherwise(F.lit("\r\r\n\n")))
    return docs.select("doc_id", X.strip_bom(X.strip_line_end(dressed)).alias("text"))


@query("fn_04_cut_bytes", r"""SELECT doc_id, least(octet_length(encode(text)), 1000) AS kept, octet_length(encode(text)) + 1 > 1000 AS truncated FROM documents""")
def cut_bytes(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    return docs.select(
        "doc_id",
        F.octet_length(X.cut_bytes(C("raw"), 1000)).cast("bigint").alias("kept"),
        X.is_cut(F.octet_length("raw") + 1, 1000).alias("truncated"),
    )


@query("fn_05_two_byte_line_breaks", rf"""WITH {D.LINES} SELECT doc_id, line_no, content FROM file_lines""")
def two_byte_lines(spark, sf):
    from logquarry.sources.textlines import lines_of_content

    docs = views.table(spark, sf, "documents")
    little = F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))
    big = F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE"))
    wide = docs.select("doc_id", F.when(C("doc_id") % 2 == 0, little).otherwise(big).alias("content"))
    return lines_of_content(wide).select("doc_id", "line_no", "content")


TOKENS = r"""list_filter(string_split_regex(lower(NAME), '[^\p{L}\p{N}]+'), lambda x: x <> '' AND octet_length(encode(x)) < 40)"""
CAMEL = r"""regexp_replace(regexp_replace(NAME, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')"""


def _token_sql(name: str) -> str:
    return f"list_concat({TOKENS.replace('NAME', name)}, {TOKENS.replace('NAME', CAMEL.replace('NAME', name))})"


@query("fn_06_name_tokens", rf"""WITH {D.SPELLINGS}
SELECT DISTINCT doc_id, unnest({_token_sql('path')}) AS token FROM spellings""")
def name_tokens(spark, sf):
    return _spelled(spark, sf, token=F.explode(X.name_tokens(C("path"))))


@query("fn_07_query_tokens", rf"""SELECT DISTINCT doc_id, unnest({_token_sql("translate(text, '-+,.:/\\_', '        ')")}) AS token FROM documents""")
def query_token_rows(spark, sf):
    docs = views.table(spark, sf, "documents")
    return docs.select("doc_id", F.explode(X.query_token_column(C("text"))).alias("token"))


@query("fn_08_query_terms", r"""SELECT doc_id, pos, term FROM (
 SELECT doc_id, unnest(terms) AS term, unnest(range(1, len(terms) + 1)) AS pos
 FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS terms FROM documents))""")
def query_term_rows(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", F.posexplode(X.query_term_column(C("text"))).alias("pos", "term"))
    return docs.select("doc_id", (C("pos") + 1).cast("bigint").alias("pos"), "term")


@query("fn_09_trigrams", rf"""WITH {D.CATALOG}
SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(path) - 1), lambda i: substr(path, i, 3))) AS gram FROM catalog""")
def trigram_rows(spark, sf):
    return views.files(spark, sf).select("doc_id", F.explode(X.trigrams(C("path"))).alias("gram"))


@query("fn_10_case_folding", r"""SELECT doc_id, lower(text) AS folded FROM documents""")
def case_folding(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", F.lower("text").alias("folded"))


@query("fn_11_suffix_test", rf"""WITH {D.SPELLINGS}
SELECT doc_id, ends_with(lower(path), '.log') OR ends_with(lower(path), '.gz') AS hit FROM spellings""")
def suffix_test(spark, sf):
    from logquarry.functions.classify import has_suffix

    return _spelled(spark, sf, hit=has_suffix(C("path"), [".Log", ".GZ"]))


@query("fn_12_file_stem", rf"""WITH {D.CATALOG}
SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'doc-'||doc_id||'.tar' ELSE 'doc-'||doc_id END AS stem FROM catalog""")
def file_stem(spark, sf):
    return views.catalog(spark, sf).select("doc_id", P.file_stem(C("name")).alias("stem"))


@query("fn_13_attribute_bits", rf"""WITH {D.NODES}
SELECT id, seq, attributes & 16 <> 0 AS is_directory, attributes & 1024 <> 0 AS is_reparse FROM nodes""")
def attribute_bits(spark, sf):
    from logquarry.constants import ATTR_DIRECTORY, ATTR_REPARSE
    from logquarry.functions.classify import has_bits

    nodes = views.nodes(spark, sf)
    return nodes.select(
        "id",
        "seq",
        has_bits(C("attributes"), ATTR_DIRECTORY).alias("is_directory"),
        has_bits(C("attributes"), ATTR_REPARSE).alias("is_reparse"),
    )


@query("fn_14_octal_and_byte_sum", r"""SELECT doc_id, doc_id AS octal, CAST(list_sum(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c))) AS BIGINT) AS total
FROM documents""")
def octal(spark, sf):
    from logquarry.functions.classify import byte_sum, octal_value

    docs = views.table(spark, sf, "documents").select("doc_id", C("doc_id").cast("string").alias("digits"))
    field = F.encode(F.concat(F.lit(" "), F.lpad(F.conv("digits", 10, 8), 11, "0"), F.lit("\x00")), "UTF-8")
    return docs.select(
        "doc_id", octal_value(field).alias("octal"), byte_sum(F.encode("digits", "UTF-8")).cast("bigint").alias("total")
    )


@query("fn_15_same_path", rf"""WITH {D.SPELLINGS} SELECT doc_id, doc_id % 5 IN (0, 3) AS same FROM spellings""")
def same_path(spark, sf):
    rows = views.spellings(spark, sf)
    other = F.when(C("doc_id") % 5 == 0, F.upper(F.replace(C("path"), F.lit("\\"), F.lit("/")))).when(
        C("doc_id") % 5 == 3, F.replace(F.regexp_replace(C("path"), "/$", ""), F.lit("//"), F.lit("/"))
    ).otherwise(F.lower("path"))
    return rows.select("doc_id", P.same_path(C("path"), other).alias("same"))
