"""The file-log domain seen in the given tables.

The tables hold no log files, so documents stand for files, events for log
lines, change records and file events, and user ids for a tree of nodes.  Every
view is a projection of one whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.functions.classify import is_archive_name, is_log_name
from logquarry.functions.paths import file_name, parent_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, path, size``: one file per document."""
    return spark.sql(
        """
        SELECT doc_id,
               concat('/data/', source, '/', lang, '/doc-', doc_id,
                 CASE doc_id % 10 WHEN 0 THEN '.zip' WHEN 1 THEN '.tar.gz' WHEN 2 THEN '.txt'
                      WHEN 3 THEN '.json' WHEN 4 THEN '.bin' WHEN 5 THEN '.out'
                      WHEN 6 THEN '.cc' ELSE '.log' END) AS path,
               n_chars AS size
        FROM {docs}
        """,
        docs=table(spark, sf_dir, "documents"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files`` with the catalog's columns."""
    base = files(spark, sf_dir).withColumn("name", file_name(F.col("path")))
    return base.select(
        "doc_id",
        "path",
        "name",
        parent_dir(F.col("path")).alias("parent"),
        "size",
        (F.lit(1_700_000_000_000) + F.col("doc_id") * 1000).alias("modified_ms"),
        is_log_name(F.col("name")).alias("is_log"),
        is_archive_name(F.col("name")).alias("is_archive"),
    )


def spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, path``: file paths in the spellings of several platforms."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    number = F.col("doc_id").cast("string")
    bs = F.lit("\\")
    drive = F.concat(F.lit("C:"), bs, F.lit("Data"), bs, F.col("source"), F.lit("/Doc-"), number, F.lit(".LOG"))
    unc = F.concat(F.lit("\\\\?\\UNC\\host\\"), F.col("source"), F.lit("\\Doc-"), number)
    verbatim = F.concat(F.lit("\\\\?\\D:\\"), F.col("lang"), F.lit("\\.hidden"), number)
    doubled = F.concat(F.lit("/data//"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/Error404Page"), number, F.lit(".Txt/"))
    plain = F.concat(F.lit("/data/"), F.col("source"), F.lit("/DataPatch-Controller_"), number, F.lit(".tar.GZ"))
    kind = F.col("doc_id") % 5
    return docs.select(
        "doc_id",
        F.when(kind == 0, drive).when(kind == 1, unc).when(kind == 2, verbatim)
        .when(kind == 3, doubled).otherwise(plain).alias("path"),
    )


def level_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, user_id, line``: events as log lines of per-user files."""
    return spark.sql(
        """
        SELECT event_id, user_id,
               concat(event_id, ' ',
                 CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'INFO'
                      WHEN 'view' THEN 'DEBUG' WHEN 'click' THEN 'WARN' ELSE 'NOTE' END,
                 ' ', props) AS line
        FROM {events}
        """,
        events=table(spark, sf_dir, "events"),
    )


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, id, parent_id, name, attributes, reason``: events as change records."""
    return spark.sql(
        """
        SELECT event_id AS seq, user_id AS id, user_id DIV 10 AS parent_id,
               concat('n', user_id, CASE WHEN event_type = 'view' THEN '-v' ELSE '' END) AS name,
               CASE WHEN user_id % 3 = 0 OR user_id < 15 THEN 16 ELSE 0 END AS attributes,
               CASE WHEN user_id = 0 THEN 256 WHEN event_type = 'error' THEN 512
                    WHEN event_type = 'click' THEN 4096 WHEN event_type = 'signup' THEN 256
                    ELSE 8192 END AS reason
        FROM {events}
        """,
        events=table(spark, sf_dir, "events"),
    )


def user_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, parent_id, name, attributes, seq``: the tree before any journal record."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    directory = (F.col("user_id") % 3 == 0) | (F.col("user_id") < 15)
    return users.select(
        F.col("user_id").alias("id"),
        F.floor(F.col("user_id") / 10).alias("parent_id"),
        F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("name"),
        F.when(directory, 16).otherwise(0).alias("attributes"),
        F.lit(-1).cast("bigint").alias("seq"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, parent_id, name, attributes, seq``: a tree with all its faults.

    Order keys stand for nodes; the parent of a node is its number divided by
    ten.  Some branches are reparse points, some nodes lack their parent, two
    directories point at each other, and some ids are recorded twice.
    """
    return spark.sql(
        """
        SELECT o_orderkey AS id,
               CASE WHEN o_orderkey = 0 THEN 0
                    WHEN o_orderkey = 31 THEN 32 WHEN o_orderkey = 32 THEN 31
                    WHEN o_orderkey % 97 = 96 THEN -o_orderkey
                    ELSE o_orderkey DIV 10 END AS parent_id,
               concat('n', o_orderkey, CASE WHEN copy = 1 THEN 'b' ELSE '' END) AS name,
               CASE WHEN o_orderkey % 89 = 47 THEN 1040
                    WHEN o_orderkey < 100 OR o_orderkey % 3 = 0 THEN 16 ELSE 0 END AS attributes,
               o_orderkey * 2 + copy AS seq
        FROM (SELECT o_orderkey, explode(CASE WHEN o_orderkey % 50 = 7 THEN array(0, 1) ELSE array(0) END) AS copy
              FROM {orders})
        """,
        orders=table(spark, sf_dir, "orders"),
    )


def size_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, path, size``: events as size samples of per-user files."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("/in/u"), F.col("user_id").cast("string"), F.lit(".log")).alias("path"),
        F.floor(F.col("value") / 40).alias("size"),
    )


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, ts, watch_dir, op, path, old_path, present``: events as file events.

    Twenty users share a watched directory.  Some events concern a file one
    level too deep, some renames lack their pair and some targets are gone.
    """
    return spark.sql(
        """
        SELECT event_id AS seq, ts, concat('/w/d', user_id DIV 20) AS watch_dir,
               CASE WHEN event_id % 4001 = 17 THEN 'rename_unpaired'
                    WHEN event_type = 'signup' THEN 'create'
                    WHEN event_type = 'view' THEN 'modify'
                    WHEN event_type = 'error' THEN 'remove'
                    WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'rename'
                    ELSE 'access' END AS op,
               concat('/w/d', user_id DIV 20, CASE WHEN event_id % 11 = 5 THEN '/sub' ELSE '' END,
                      '/f', user_id, '.log') AS path,
               CASE WHEN event_type = 'click' AND event_id % 2 = 0
                    THEN concat('/w/d', user_id DIV 20, '/f', user_id + 1 - 2 * (user_id % 2), '.log')
                    END AS old_path,
               event_id % 2003 <> 9 AS present
        FROM {events}
        """,
        events=table(spark, sf_dir, "events"),
    )
