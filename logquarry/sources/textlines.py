"""Text files as line tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.constants import MAX_FILE_BYTES
from logquarry.functions.text import charset_name, decode_bytes, detect_charset, lenient_charsets
from logquarry.operators.lines import finish_lines, number_blocks, split_text
from logquarry.sources.files import plain_path


def raw_lines(spark: SparkSession, paths) -> DataFrame:
    """``path, block_start, row_id, raw, raw_len`` of splittable text files.

    Only a line feed ends a line.  The value keeps the bytes of the file, so it
    can be decoded later by any charset whose trail bytes exclude the line feed.
    """
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(paths)
    raw = F.col("value").cast("binary")
    return text.select(
        plain_path(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_id"),
        raw.alias("raw"),
        # The line feed counts; whether the last line has one cannot be seen here.
        (F.octet_length(raw) + 1).cast("bigint").alias("raw_len"),
    )


def read_lines(spark: SparkSession, paths, charset: str | None = None, limit: int | None = None) -> DataFrame:
    """``path, line_no, raw_len, content, truncated`` of files of any size.

    For UTF-8, GBK and GB18030; without a charset each file gets its own, UTF-8
    where all of its bytes are, else GB18030.  UTF-16 needs
    the line index of :mod:`logquarry.sources.lineindex`, because its line feed is
    two bytes wide.  ``limit`` cuts lines to so many bytes.
    """
    if charset is None:
        return finish_lines(number_blocks(raw_lines(spark, paths), charset=True), F.col("charset"), limit).drop("charset")
    name = charset_name(charset)
    if name.startswith("UTF-16"):
        raise ValueError("UTF-16 files are not splittable by line feed bytes; use the line index")
    return finish_lines(number_blocks(raw_lines(spark, paths)), name, limit)


def read_whole_files(spark: SparkSession, paths, charset: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines of whole files with their own charset, and the files refused.

    Each file is one row, so this is for files that cannot be split.  Files above
    the size limit are listed by metadata alone and never opened.
    """
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    named = source.select(plain_path(F.col("path")).alias("path"), F.col("length").alias("size"), "content")
    files, refused = split_by_limit(named)
    return lines_of_content(files.drop("size"), charset), refused.select("path", "size", "error")


def split_by_limit(files: DataFrame, limit: int = MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Files small enough to read, and the others with an ``error``."""
    fits = F.col("size") <= limit
    return files.where(fits), files.where(~fits).withColumn("error", F.lit("size limit"))


def lines_of_content(files: DataFrame, charset: str | None = None, limit: int | None = None) -> DataFrame:
    """``path, charset, line_no, content`` of ``path, content`` rows.

    The whole content is decoded before it is split, which keeps the two-byte
    line feed of UTF-16 aligned.
    """
    chosen = F.lit(charset_name(charset)) if charset else detect_charset(F.col("content"))
    with lenient_charsets(files.sparkSession):
        text = files.withColumn("charset", chosen).withColumn(
            "text", decode_bytes(F.col("content"), F.col("charset"))
        )
    return split_text(text.drop("content"))
