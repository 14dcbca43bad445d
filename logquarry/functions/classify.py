"""Classification columns: by name, by leading bytes, by text sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from logquarry.constants import (
    ARCHIVE_SUFFIXES,
    CONTENT_TYPES,
    DEFAULT_CONTENT_TYPE,
    LOG_EXTENSIONS,
    MAGIC,
    SAMPLE_BYTES,
    STREAM_MAGIC,
)
from logquarry.functions.paths import extension, same_path


def is_log_name(name: Column) -> Column:
    """Is the file a log by its extension?"""
    return extension(name).isin(LOG_EXTENSIONS)


def archive_format_by_name(name: Column) -> Column:
    """Archive format its suffix names, null for none."""
    lowered = F.lower(name)
    ladder = None
    for suffix, fmt in ARCHIVE_SUFFIXES:
        test = F.endswith(lowered, F.lit(suffix))
        ladder = F.when(test, F.lit(fmt)) if ladder is None else ladder.when(test, F.lit(fmt))
    return ladder


def is_archive_name(name: Column) -> Column:
    """Does the suffix name an archive?"""
    return archive_format_by_name(name).isNotNull()


def kind(is_log: Column, is_archive: Column) -> Column:
    """``archive`` before ``log`` before ``file``."""
    return F.when(is_archive, F.lit("archive")).when(is_log, F.lit("log")).otherwise(F.lit("file"))


def content_type(name: Column) -> Column:
    """Content type by extension."""
    table = F.create_map(*[F.lit(item) for pair in CONTENT_TYPES.items() for item in pair])
    return F.coalesce(F.try_element_at(table, extension(name)), F.lit(DEFAULT_CONTENT_TYPE))


def octal_value(field: Column) -> Column:
    """Value of an octal text field padded with NULs or spaces; null if not octal."""
    digits = F.regexp_replace(F.decode(field, "ISO-8859-1"), r"^[\x00 ]+|[\x00 ]+$", "")
    return F.when(digits.rlike("^[+]?[0-7]+$"), F.conv(F.replace(digits, F.lit("+")), 8, 10).cast("bigint"))


def byte_sum(content: Column) -> Column:
    """Sum of all byte values, read as Latin-1 characters."""
    latin = F.decode(content, "ISO-8859-1")
    return F.aggregate(
        F.transform(F.split(latin, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.ascii(c))),
        F.lit(0),
        lambda total, value: total + value,
    )


def is_tar_header(head: Column) -> Column:
    """``ustar`` at byte 257, or an octal checksum equal to the byte sum."""
    block = F.substring(head, 1, 512)
    ustar = F.hex(F.substring(block, 258, 5)) == "7573746172"
    stored = octal_value(F.substring(block, 149, 8))
    total = byte_sum(F.substring(block, 1, 148)) + 8 * 32 + byte_sum(F.substring(block, 157, 356))
    return (F.octet_length(block) >= 512) & (ustar | F.coalesce(stored == total, F.lit(False)))


def is_zero_block(head: Column) -> Column:
    """Are the first 512 bytes all present and zero?"""
    return F.hex(F.substring(head, 1, 512)) == "00" * 512


def stream_compression(head: Column) -> Column:
    """Compression of a stream by its leading bytes, null for none."""
    lead = F.hex(F.substring(head, 1, 8))
    ladder = None
    for magic, fmt in STREAM_MAGIC:
        test = F.startswith(lead, F.lit(magic))
        ladder = F.when(test, F.lit(fmt)) if ladder is None else ladder.when(test, F.lit(fmt))
    return ladder


def detect_format(head: Column, name: Column, decoded_head: Column | None = None) -> Column:
    """Format by leading bytes; the name only decides about empty TARs.

    ``decoded_head`` holds the first 512 decompressed bytes of a compressed
    stream.  Without it a compressed stream is never taken for a TAR.
    """
    lead = F.hex(F.substring(head, 1, 8))
    named = archive_format_by_name(name)
    ladder = F.when(F.startswith(lead, F.lit(MAGIC[0][0])), F.lit(MAGIC[0][1]))
    for magic, fmt in MAGIC[1:]:
        ladder = ladder.when(F.startswith(lead, F.lit(magic)), F.lit(fmt))
    ladder = ladder.when(is_tar_header(head), F.lit("tar"))
    stream = stream_compression(head)
    tarred = F.concat(F.lit("tar."), stream)
    if decoded_head is None:
        ladder = ladder.when(stream.isNotNull(), stream)
    else:
        holds_tar = is_tar_header(decoded_head) | (
            F.coalesce(named == tarred, F.lit(False)) & is_zero_block(decoded_head)
        )
        ladder = ladder.when(
            stream.isNotNull(), F.when(F.coalesce(holds_tar, F.lit(False)), tarred).otherwise(stream)
        )
    empty_tar = F.coalesce(named == "tar", F.lit(False)) & is_zero_block(head)
    return ladder.when(empty_tar, F.lit("tar")).otherwise(F.lit("plain"))


def is_text_sample(content: Column) -> Column:
    """Text by sample: empty is text, any NUL is not, few control bytes are."""
    sample = F.decode(F.substring(content, 1, SAMPLE_BYTES), "ISO-8859-1")
    control = F.regexp_count(sample, F.lit(r"[\x01-\x08\x0e-\x1f]"))
    return (F.length(sample) == 0) | (
        ~F.contains(sample, F.lit("\x00")) & (control / F.greatest(F.length(sample), F.lit(1)) < 0.10)
    )


def arrival_kind(content: Column, name: Column, fmt: Column) -> Column:
    """``archive`` by bytes, else ``file`` when it is text, else null (dropped)."""
    return F.when(fmt != "plain", F.lit("archive")).when(
        is_log_name(name) | is_text_sample(content), F.lit("file")
    )


def has_suffix(name: Column, suffixes: Sequence[str]) -> Column:
    """Does the name end with any of the suffixes, ignoring case?"""
    test = F.lit(False)
    for suffix in suffixes:
        test = test | F.endswith(F.lower(name), F.lit(suffix.lower()))
    return test


def passes_filter(name: Column, archive: Column, suffixes: Sequence[str], show_all: bool = False) -> Column:
    """Announce archives always, everything when ``show_all``, else by suffix."""
    return F.lit(True) if show_all else archive | has_suffix(name, suffixes)


def visible_in_tree(
    name: Column,
    node_kind: Column,
    path: Column,
    suffixes: Sequence[str],
    show_all: bool = False,
    active_path: str | None = None,
) -> Column:
    """Directories and archives always, else by suffix; the active node stays."""
    shown = node_kind.isin("dir", "archive")
    shown = F.lit(True) if show_all else shown | has_suffix(name, suffixes)
    if active_path is not None:
        shown = shown | ((node_kind == "file") & same_path(path, F.lit(active_path)))
    return shown


def is_safe_entry(name: Column, max_bytes: int) -> Column:
    """Entry names that cannot escape, cannot be confused and are not overlong."""
    parts = F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/")
    return (
        (F.octet_length(name) > 0)
        & (F.octet_length(name) <= max_bytes)
        & ~F.contains(name, F.lit("\x00"))
        & ~name.rlike(r"^[/\\]")
        & ~F.contains(name, F.lit("::"))
        & ~F.exists(parts, lambda part: (part == "..") | F.contains(part, F.lit(":")))
    )


def has_bits(value: Column, bits: int) -> Column:
    """Is any of the bits set?"""
    return value.bitwiseAND(F.lit(bits)) != 0
