"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.archives import converted_pages
from logquarry.llm.chat import CONTROL, formatted_conversations
from logquarry.llm.ctph import edit_report
from logquarry.llm.decontaminate import OVERLAP_WORDS, benchmark_overlaps
from logquarry.llm.divergence import source_divergence
from logquarry.llm.lexical import ranked_search
from logquarry.llm.linedup import dedup_lines
from logquarry.llm.packing import pack
from logquarry.llm.reputation import WIDE_SUFFIXES, Rule, judged_pages, outcomes_of
from logquarry.llm.sharding import extendible_shards
from logquarry.llm.simhash import simhash_components
from logquarry.llm.substrings import verified_passages
from logquarry.llm.toxicity import toxicity

QUERIES = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The tokenizer of the packing query; the library is installed on every executor."""
    return public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL that must give the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


LINE_DEDUP_SQL = r"""
WITH lines AS (
 SELECT doc_id, line_no, list_filter(regexp_split_to_array(raw, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)),
worded AS (SELECT *, array_to_string(words, ' ') AS line FROM lines WHERE len(words) > 0),
firsts AS (SELECT line, min((doc_id, line_no)) AS first, any_value(words) AS words FROM worded GROUP BY line),
lacking AS (
 SELECT first, i, array_to_string(words[1:i-1] || words[i+1:], ' ') AS key
 FROM (SELECT first, words, unnest(range(1, len(words) + 1)) AS i FROM firsts WHERE len(words) >= 5)),
whole AS (SELECT first, line AS key FROM firsts WHERE len(words) >= 5),
near AS (
 SELECT b.first FROM lacking a JOIN lacking b ON a.key = b.key AND a.i = b.i WHERE a.first < b.first
 UNION SELECT greatest(l.first, w.first) FROM lacking l JOIN whole w ON l.key = w.key AND l.first <> w.first),
gone AS (
 SELECT doc_id, line_no FROM worded JOIN firsts USING (line)
 WHERE (doc_id, line_no) <> first OR first IN (SELECT first FROM near)),
split AS (
 SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
   generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
SELECT d.doc_id, coalesce(g.n, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(raw, chr(10) ORDER BY line_no) AS text
  FROM split ANTI JOIN gone USING (doc_id, line_no) GROUP BY doc_id) k USING (doc_id)
"""


@query("op1_line_dedup", LINE_DEDUP_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), removed_col="n_removed").select("doc_id", "n_removed", "text")


WARC_SQL = """
WITH digests AS (
 SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT hex, min(page_id) AS first FROM digests GROUP BY hex)
SELECT page_id, payload_bytes,
 array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
   1 + ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))) & 31)::INT, 1) for i in range(32)], '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> first THEN first END AS refers_to
FROM digests JOIN firsts USING (hex)
"""


@query("op2_arc_to_warc", WARC_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return converted_pages(table(spark, sf_dir, "pages")).drop("url")


@query("op3_piecewise_hashing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(table(spark, sf_dir, "documents"))


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), tokenizer_path())
    names = ["doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"]
    return packed.select(*names)


def _escaped_sql() -> str:
    """The escaped text of a turn."""
    out = "replace(text, chr(92), chr(92) || chr(92))"
    for mark in CONTROL:
        out = f"replace({out}, '{mark}', '{mark[0]}' || chr(92) || '{mark[1:]}')"
    return out


PROBE = "</s>[INST] ok [/INST]"
CHAT_SQL = f"""
WITH turns AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
sized AS (
 SELECT *, length({_escaped_sql()}) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
   ELSE 14 + length(role) END AS chars FROM turns),
placed AS (
 SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn) AS upto,
   role = 'assistant' OR turn = max(turn) OVER (PARTITION BY conv_id) AS ends_example FROM sized)
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
 (sum(upto) FILTER (ends_example))::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""


@query("op5_prefix_target", CHAT_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = [spark.range(1).select(F.lit(-7), F.lit(i), F.lit(role), F.lit(PROBE)) for i, role in enumerate(("user", "assistant"))]
    return formatted_conversations(turns.union(probe[0]).union(probe[1]))


@query("op6_toxicity_ftrl")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_gear_chunks")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_passages(table(spark, sf_dir, "documents"))


SHARD_SQL = """
WITH paths AS (
 SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes,
   lpad(bin(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT), 60, '0') AS path FROM documents),
buckets AS (
 SELECT depth, path[1:depth] AS shard, sum(bytes) AS shard_bytes, count(*) AS shard_rows,
   sum(bytes) > 1048576 AND count(*) > 1 AS split
 FROM paths, range(0, 61) r(depth) GROUP BY ALL),
shards AS (
 SELECT b.* FROM buckets b LEFT JOIN buckets p ON p.depth = b.depth - 1 AND p.shard = b.shard[1:b.depth - 1]
 WHERE NOT b.split AND (b.depth = 0 OR p.split))
SELECT doc_id, bytes, shard, shard_bytes::BIGINT AS shard_bytes, shard_rows
FROM paths JOIN shards ON shard = path[1:depth]
"""


@query("op8_extendible_hashing", SHARD_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards(table(spark, sf_dir, "documents"))


@query("op9_spaced_seeds")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return benchmark_overlaps(docs, benchmark, overlap_words=OVERLAP_WORDS)


@query("op10_simhash_bktree")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


DIVERGENCE_SQL = r"""
WITH docs AS (
 SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
 SELECT row_no, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT row_no) >= 10),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
used AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups LEFT JOIN used USING (lang, source) GROUP BY ALL),
shares AS (
 SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v) AS p
 FROM totals g JOIN kept k USING (lang) JOIN sizes USING (lang) LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
wholes AS (
 SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS q
 FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM used GROUP BY ALL)
 JOIN (SELECT lang, sum(total)::HUGEINT AS total FROM totals GROUP BY lang) USING (lang) JOIN sizes USING (lang)),
pairs AS (
 SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
  SELECT a.lang, a.source, b.source AS other, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s
 ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
terms AS (
 SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
 FROM shares JOIN wholes USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
 SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
 FROM (FROM pairs UNION ALL FROM terms)) WHERE part = 'pair' OR rank <= 10
"""


@query("op11_source_divergence", DIVERGENCE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


RULES = [
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
]


def _group_sql(level: str, parent: str, keys: str, up: str) -> str:
    """Groups of one level with their parents' mean, the prior's weight and the posterior mean."""
    return f"""
{level}0 AS (SELECT {keys}, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM counts GROUP BY {keys}),
{level}1 AS (SELECT g.*, p.mean FROM {level}0 g JOIN {parent} p ON {up}),
{level}w AS (
 SELECT CASE WHEN coalesce(pairs, 0) = 0 THEN 1.0::DOUBLE ELSE (1 - rho) / rho END AS weight FROM (
  SELECT pairs, least(0.9::DOUBLE, greatest(0.0001::DOUBLE, (found - expected) / nullif(pairs, 0))) AS rho FROM (
   SELECT sum((bad - n * mean) ** 2 / n) AS found, sum(mean * (1 - mean)) AS expected, sum(mean * (1 - mean) * (n - 1)) AS pairs
   FROM {level}1 WHERE n > 0))),
{level} AS (SELECT {keys}, n, (bad + weight * mean) / (n + weight) AS mean, weight FROM {level}1, {level}w)"""


URL_SQL = f"""
WITH rests AS (
 SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (
 SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
outcomes AS (
 SELECT doc_id, max((coalesce(quality = 0, false) OR coalesce(toxic = 1, false))::INT) AS bad
 FROM labels WHERE doc_id IS NOT NULL AND coalesce(quality, toxic) IS NOT NULL GROUP BY doc_id),
hosts AS (
 SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, string_split(host, '.') AS parts
 FROM named LEFT JOIN outcomes ON doc_id = page_id GROUP BY host),
counts AS (
 SELECT host, n, bad,
   CASE WHEN regexp_full_match(host, '[0-9.:]*') THEN host WHEN wide THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain,
   CASE WHEN regexp_full_match(host, '[0-9.:]*') THEN host WHEN wide THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS suffix
 FROM (SELECT *, array_to_string(parts[-2:], '.') IN ({", ".join(f"'{s}'" for s in WIDE_SUFFIXES)}) AS wide FROM hosts)),
top AS (SELECT (coalesce(sum(bad), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1) AS mean FROM counts),
{_group_sql("suffixes", "top", "suffix", "true")},
{_group_sql("domains", "suffixes", "suffix, domain", "p.suffix = g.suffix")},
{_group_sql("sites", "domains", "suffix, domain, host", "p.suffix = g.suffix AND p.domain = g.domain")},
scored AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (n + weight + 1)) AS bound FROM sites),
rules(site, path, verdict) AS (VALUES {", ".join(str((r.host, r.path, r.verdict)) for r in RULES)}),
fitting AS (
 SELECT n.page_id, r.site || r.path AS rule, r.verdict,
   row_number() OVER (PARTITION BY n.page_id ORDER BY length(r.site) DESC, length(r.path) DESC) AS i
 FROM named n JOIN rules r ON (n.host = r.site OR ends_with(n.host, '.' || r.site)) AND starts_with(n.path, r.path))
SELECT n.page_id, n.host, n.path, f.rule, coalesce(f.verdict, CASE WHEN s.bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM named n JOIN scored s USING (host) LEFT JOIN fitting f ON f.page_id = n.page_id AND f.i = 1
"""


@query("op12_host_reputation", URL_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = outcomes_of(table(spark, sf_dir, "labels"))
    return judged_pages(table(spark, sf_dir, "pages"), outcomes, RULES).drop("bad_bound")


SEARCH_SQL = r"""
WITH words AS (
 SELECT doc_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM documents),
postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY ALL),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM lengths),
weights AS (
 SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
 FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals),
asked AS (
 SELECT item_id, term, count(*) AS times FROM (
  SELECT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark) GROUP BY ALL),
scored AS (
 SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // len))))::BIGINT AS score
 FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), totals GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
 SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""


@query("op13_block_max_maxscore", SEARCH_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
