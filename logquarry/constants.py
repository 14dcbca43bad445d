"""Fixed values of the file-log domain.

Everything here is a value that results depend on: word lists, byte
signatures and limits.  They are stated once, plainly, and imported from here.
"""

from __future__ import annotations

from dataclasses import dataclass

# Extensions that mark a file as a log by name.
LOG_EXTENSIONS = ["log", "txt", "out", "err", "trace", "json", "csv"]

# Archive suffixes, longest first, and the format each one names.
ARCHIVE_SUFFIXES = [
    (".tar.bz2", "tar.bz2"),
    (".tar.zst", "tar.zst"),
    (".tar.gz", "tar.gz"),
    (".tar.xz", "tar.xz"),
    (".tbz2", "tar.bz2"),
    (".tzst", "tar.zst"),
    (".tgz", "tar.gz"),
    (".tbz", "tar.bz2"),
    (".txz", "tar.xz"),
    (".zip", "zip"),
    (".7z", "7z"),
    (".rar", "rar"),
    (".tar", "tar"),
    (".gz", "gz"),
    (".bz2", "bz2"),
    (".xz", "xz"),
    (".zst", "zst"),
]

# Content type by extension; anything else is an octet stream.
CONTENT_TYPES = {
    "zip": "application/zip",
    "7z": "application/x-7z-compressed",
    "rar": "application/vnd.rar",
    "tar": "application/x-tar",
    "gz": "application/gzip",
    "tgz": "application/gzip",
    "bz2": "application/x-bzip2",
    "tbz2": "application/x-bzip2",
    "xz": "application/x-xz",
    "txz": "application/x-xz",
    "log": "text/plain",
    "txt": "text/plain",
    "out": "text/plain",
    "err": "text/plain",
    "trace": "text/plain",
    "json": "text/plain",
    "xml": "text/plain",
    "yaml": "text/plain",
    "yml": "text/plain",
}
DEFAULT_CONTENT_TYPE = "application/octet-stream"

# Suffixes announced by default.
DEFAULT_SUFFIXES = [".log", ".txt", ".out"]

# Directory prefixes never scanned on macOS.
PLATFORM_SKIPPED = ["/Volumes", "/System/Volumes", "/Network", "/dev", "/net", "/home"]

# Leading bytes (hex) of whole-file formats.
MAGIC = [
    ("504B0304", "zip"),
    ("504B0506", "zip"),
    ("504B0708", "zip"),
    ("377ABCAF271C", "7z"),
    ("526172211A0700", "rar"),
    ("526172211A070100", "rar"),
]

# Leading bytes (hex) of compressed streams.
STREAM_MAGIC = [
    ("1F8B", "gz"),
    ("425A68", "bz2"),
    ("FD377A585A00", "xz"),
    ("28B52FFD", "zst"),
]

# Byte order marks (hex) and the charset each one names.
BYTE_ORDER_MARKS = [("EFBBBF", "UTF-8"), ("FFFE", "UTF-16LE"), ("FEFF", "UTF-16BE")]

# Accepted charset spellings.
CHARSETS = {
    "UTF-8": "UTF-8",
    "UTF8": "UTF-8",
    "GBK": "GBK",
    "GB18030": "GB18030",
    "UTF-16LE": "UTF-16LE",
    "UTF16LE": "UTF-16LE",
    "UTF-16BE": "UTF-16BE",
    "UTF16BE": "UTF-16BE",
}

# Level words of a log line.
LEVELS = ["ERROR", "WARN", "INFO", "DEBUG", "TRACE", "FATAL"]

# Attribute and reason bits of nodes and journal records.
ATTR_DIRECTORY = 0x10
ATTR_REPARSE = 0x400
REASON_DELETE = 0x200
REASON_RENAME_OLD = 0x1000
ROOT_FILE_NUMBER = 5

# Limits.
MAX_FILE_BYTES = 2 * 1024**3
MAX_LINE_BYTES = 65_536
SAMPLE_BYTES = 4_096
MAX_PAGE = 500
MAX_KEPT_RESULTS = 1_000
MAX_JOURNAL_REPLAY = 1_000_000
STABLE_REPEATS = 3
STABLE_SAMPLES = 20
MAX_TOKEN_BYTES = 40


UNLIMITED = 2**62


@dataclass(frozen=True)
class ArchiveLimits:
    """Limits of one archive expansion; only the depth of nesting has one unless it is given.

    Nothing depends on the clock, so a slow node gives the rows of a fast one.
    """

    max_nested_depth: int = 5
    max_decoded_bytes: int = UNLIMITED
    max_entries: int = UNLIMITED
    max_path_bytes: int = UNLIMITED
    max_scan_bytes: int = UNLIMITED


# The limits of a desktop viewer.
VIEWER_LIMITS = ArchiveLimits(
    max_decoded_bytes=2 * 1024**3, max_entries=100_000, max_path_bytes=4_096, max_scan_bytes=4 * 1024**3
)
