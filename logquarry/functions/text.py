"""Text columns: encodings, lines, levels, tokens, terms and highlights."""

from __future__ import annotations

import re
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from logquarry.constants import (
    BYTE_ORDER_MARKS,
    CHARSETS,
    LEVELS,
    MAX_LINE_BYTES,
    MAX_TOKEN_BYTES,
    SAMPLE_BYTES,
)


@contextmanager
def lenient_charsets(spark: SparkSession):
    """Build ``decode`` columns that know the GBK family and replace bad bytes.

    Spark reads both settings when a column is resolved, so it is enough to hold
    them while the DataFrame is being built.
    """
    names = ["spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction"]
    before = {name: spark.conf.get(name, "false") for name in names}
    for name in names:
        spark.conf.set(name, "true")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def charset_name(label: str) -> str:
    """Canonical charset of a user's spelling; unknown names are refused."""
    found = CHARSETS.get(label.strip().upper())
    if found is None:
        raise ValueError(f"unsupported charset: {label}")
    return found


def charset_column(label: Column) -> Column:
    """Canonical charset of a label column, null when unsupported."""
    table = F.create_map(*[F.lit(item) for pair in CHARSETS.items() for item in pair])
    return F.try_element_at(table, F.upper(F.trim(label)))


def detect_charset(content: Column) -> Column:
    """Charset of leading bytes: a BOM, else valid UTF-8, else GB18030.

    A sample may end inside a character, so up to three trailing bytes of a
    full-length sample are forgiven.
    """
    sample = F.substring(content, 1, SAMPLE_BYTES)
    valid = F.is_valid_utf8(sample.cast("string"))
    for cut in (1, 2, 3):
        shorter = F.substring(content, 1, SAMPLE_BYTES - cut)
        valid = valid | ((F.octet_length(sample) == SAMPLE_BYTES) & F.is_valid_utf8(shorter.cast("string")))
    result = F.when(valid, F.lit("UTF-8")).otherwise(F.lit("GB18030"))
    for mark, name in reversed(BYTE_ORDER_MARKS):
        result = F.when(F.startswith(F.hex(F.substring(content, 1, 3)), F.lit(mark)), F.lit(name)).otherwise(result)
    return result


def decode_bytes(content: Column, charset: Column) -> Column:
    """Decode by a charset column; use inside :func:`lenient_charsets`."""
    result = F.make_valid_utf8(content.cast("string"))
    for name in ("GBK", "GB18030", "UTF-16LE", "UTF-16BE"):
        result = F.when(charset == name, F.decode(content, name)).otherwise(result)
    return result


def strip_line_end(line: Column) -> Column:
    """Drop every trailing carriage return and line feed."""
    return F.rtrim(line, F.lit("\r\n"))


def strip_bom(line: Column) -> Column:
    """Drop a leading byte order mark."""
    return F.regexp_replace(line, "^\\uFEFF", "")


def cut_bytes(raw: Column, limit: int = MAX_LINE_BYTES) -> Column:
    """Keep the first ``limit`` bytes of an undecoded line."""
    return F.when(F.octet_length(raw) > limit, F.substring(raw, 1, limit)).otherwise(raw)


def is_cut(raw_length: Column, limit: int = MAX_LINE_BYTES) -> Column:
    """Was a line of this raw length (line end included) cut?"""
    return raw_length > limit


def log_level(line: Column) -> Column:
    """First whole-word upper-case level of a line, null when there is none."""
    pattern = rf"(?<![A-Za-z0-9_])({'|'.join(LEVELS)})(?![A-Za-z0-9_])"
    return F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))


def human_size(size: Column) -> Column:
    """Size with 1024 steps: no decimals for bytes or from 100 up, else one."""

    def shown(value: Column, unit: str) -> Column:
        value = value.cast("double")
        # Half-up on the decimal value, as a fixed-point formatter does.
        whole = F.round(value, 0).cast("bigint").cast("string")
        tenths = F.round(value * 10, 0).cast("bigint")
        one = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
        return F.concat(F.when(value >= 100, whole).otherwise(one), F.lit(unit))

    return (
        F.when(size.isNull(), F.lit(""))
        .when(size < 1024, F.concat(size.cast("string"), F.lit("B")))
        .when(size < 1024**2, shown(size / 1024, "KB"))
        .when(size < 1024**3, shown(size / 1024**2, "MB"))
        .otherwise(shown(size / 1024**3, "GB"))
    )


def name_tokens(name: Column) -> Column:
    """Search tokens of a name: its words, plus its camel-case words.

    Words are runs of letters and digits, lower case; overlong ones are dropped.
    """
    camel = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    camel = F.regexp_replace(camel, "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.array_union(_words(name), _words(camel))


def _words(value: Column) -> Column:
    words = F.split(F.lower(value), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: (w != "") & (F.octet_length(w) < MAX_TOKEN_BYTES))


def query_token_column(query: Column) -> Column:
    """Tokens of a query column: separators become spaces, then name tokens."""
    return name_tokens(F.translate(query, "-+,.:/\\_", "        "))


def query_term_column(query: Column) -> Column:
    """Lower-cased whitespace-separated terms of a query column."""
    return F.filter(F.split(F.lower(query), r"\s+"), lambda term: term != "")


def query_terms(query: str) -> list[str]:
    """Lower-cased whitespace-separated terms of a query."""
    return [term for term in query.lower().split() if term]


def query_tokens(query: str) -> list[str]:
    """Tokens every name must hold for this query, each once."""
    joined = " ".join(query_terms(query))
    words = re.findall(r"[^\W_]+", joined)
    return list(dict.fromkeys(w for w in words if len(w.encode()) < MAX_TOKEN_BYTES))


def trigrams(term: Column) -> Column:
    """Distinct three-character windows of a term, in order."""
    grams = F.transform(F.sequence(F.lit(1), F.length(term) - 2), lambda i: F.substr(term, i, F.lit(3)))
    none = F.array().cast("array<string>")
    return F.when(F.length(term) >= 3, F.array_distinct(grams)).otherwise(none)


def highlight(text: Column, query: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Mark every query term, ignoring case, longest term first."""
    terms = sorted((term for term in query.strip().split() if term), key=len, reverse=True)
    if not terms:
        return text
    escaped = "|".join("\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E" for term in terms)
    return F.regexp_replace(text, f"(?iu)({escaped})", f"{before}$1{after}")
