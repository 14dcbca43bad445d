"""The domain views of ``logquarry.plans.views`` in the SQL twin's dialect."""

EXT = r"""CASE doc_id % 10 WHEN 0 THEN '.zip' WHEN 1 THEN '.tar.gz' WHEN 2 THEN '.txt'
 WHEN 3 THEN '.json' WHEN 4 THEN '.bin' WHEN 5 THEN '.out' WHEN 6 THEN '.cc' ELSE '.log' END"""

CATALOG = rf"""catalog AS (
 SELECT doc_id, '/data/'||source||'/'||lang||'/doc-'||doc_id||{EXT} AS path,
        'doc-'||doc_id||{EXT} AS name, '/data/'||source||'/'||lang AS parent, n_chars AS size,
        1700000000000 + doc_id * 1000 AS modified_ms,
        doc_id % 10 IN (2, 3, 5, 7, 8, 9) AS is_log, doc_id % 10 IN (0, 1) AS is_archive,
        source, lang
 FROM documents)"""

SPELLINGS = r"""spellings AS (
 SELECT doc_id, CASE doc_id % 5
   WHEN 0 THEN 'C:\Data\'||source||'/Doc-'||doc_id||'.LOG'
   WHEN 1 THEN '\\?\UNC\host\'||source||'\Doc-'||doc_id
   WHEN 2 THEN '\\?\D:\'||lang||'\.hidden'||doc_id
   WHEN 3 THEN '/data//'||source||'/'||lang||'/Error404Page'||doc_id||'.Txt/'
   ELSE '/data/'||source||'/DataPatch-Controller_'||doc_id||'.tar.GZ' END AS path, source, lang
 FROM documents)"""

LEVELS = r"""level_lines AS (
 SELECT event_id, user_id, event_id||' '||CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'INFO'
   WHEN 'view' THEN 'DEBUG' WHEN 'click' THEN 'WARN' ELSE 'NOTE' END||' '||props AS line
 FROM events)"""

JOURNAL = r"""journal AS (
 SELECT event_id AS seq, user_id AS id, user_id // 10 AS parent_id,
   'n'||user_id||CASE WHEN event_type = 'view' THEN '-v' ELSE '' END AS name,
   CASE WHEN user_id % 3 = 0 OR user_id < 15 THEN 16 ELSE 0 END AS attributes,
   CASE WHEN user_id = 0 THEN 256 WHEN event_type = 'error' THEN 512 WHEN event_type = 'click' THEN 4096
        WHEN event_type = 'signup' THEN 256 ELSE 8192 END AS reason
 FROM events)"""

FINAL_NODES = JOURNAL + r""", log AS (
 SELECT DISTINCT user_id AS id, user_id // 10 AS parent_id, 'n'||user_id AS name,
   CASE WHEN user_id % 3 = 0 OR user_id < 15 THEN 16 ELSE 0 END AS attributes, 0 AS reason, -1 AS seq FROM events
 UNION ALL SELECT id, parent_id, name, attributes, reason, seq FROM journal WHERE reason <> 4096),
final AS (SELECT id, arg_max(parent_id, seq) AS parent_id, arg_max(name, seq) AS name, arg_max(attributes, seq) AS attributes, max(seq) AS seq
 FROM log GROUP BY id HAVING arg_max(reason, seq) <> 512)"""

NODES = r"""nodes AS (
 SELECT o_orderkey AS id,
   CASE WHEN o_orderkey = 0 THEN 0 WHEN o_orderkey = 31 THEN 32 WHEN o_orderkey = 32 THEN 31
        WHEN o_orderkey % 97 = 96 THEN -o_orderkey ELSE o_orderkey // 10 END AS parent_id,
   'n'||o_orderkey||CASE WHEN copy = 1 THEN 'b' ELSE '' END AS name,
   CASE WHEN o_orderkey % 89 = 47 THEN 1040
        WHEN o_orderkey < 100 OR o_orderkey % 3 = 0 THEN 16 ELSE 0 END AS attributes,
   o_orderkey * 2 + copy AS seq
 FROM orders JOIN (SELECT 0 AS copy UNION ALL SELECT 1) c ON copy = 0 OR o_orderkey % 50 = 7),
last AS (SELECT id, arg_max(parent_id, seq) AS parent_id, arg_max(name, seq) AS name,
   arg_max(attributes, seq) AS attributes, max(seq) AS seq FROM nodes GROUP BY id),
dirs AS (SELECT * FROM last WHERE attributes & 16 <> 0)"""

SAMPLES = r"""samples AS (
 SELECT event_id AS seq, '/in/u'||user_id||'.log' AS path, CAST(floor(value / 40) AS BIGINT) AS size
 FROM events)"""

FILE_EVENTS = r"""file_events AS (
 SELECT event_id AS seq, '/w/d'||(user_id // 20) AS watch_dir,
   CASE WHEN event_id % 4001 = 17 THEN 'rename_unpaired' WHEN event_type = 'signup' THEN 'create'
        WHEN event_type = 'view' THEN 'modify' WHEN event_type = 'error' THEN 'remove'
        WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'rename' ELSE 'access' END AS op,
   '/w/d'||(user_id // 20)||CASE WHEN event_id % 11 = 5 THEN '/sub' ELSE '' END||'/f'||user_id||'.log' AS path,
   CASE WHEN event_type = 'click' AND event_id % 2 = 0
        THEN '/w/d'||(user_id // 20)||'/f'||(user_id + 1 - 2 * (user_id % 2))||'.log' END AS old_path,
   event_id % 2003 <> 9 AS present
 FROM events)"""

LINES = r"""file_lines AS (
 SELECT doc_id, line_no, rtrim(piece, chr(13)||chr(10)) AS content, octet_length(encode(piece)) + 1 AS raw_len
 FROM (SELECT doc_id, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS line_no, len(pieces) AS n
       FROM (SELECT doc_id, string_split(text, chr(10)) AS pieces FROM documents))
 WHERE NOT (line_no = n AND piece = ''))"""

ROOTS = r"""roots(root) AS (VALUES ('/data/src1'), ('/data/src1/en'), ('/data/src7'))"""
