"""Small task-side helpers that open one container as a stream, wherever it is stored.

Everything relational (names, limits, classes) happens in Columns afterwards.
"""

from __future__ import annotations

import bz2
import functools
import gzip
import io
import lzma
import re
import stat
import tarfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import zstandard
from pyarrow import fs

from logquarry.constants import ARCHIVE_SUFFIXES, MAGIC, SAMPLE_BYTES, STREAM_MAGIC, ArchiveLimits

# Bytes read at once; chunks of lines are about this large.
CHUNK_BYTES = 1024 * 1024
BUFFER_BYTES = 64 * 1024
# A gzip header is looked for its file name in so many bytes.
HEADER_BYTES = 64 * 1024
# Between a file and ``<first byte>+<bytes>`` of a section; no file name holds it.
SECTION = "\0"
CONTROL = bytes([*range(1, 9), *range(14, 32)])

OPENERS = {
    "gz": lambda file: gzip.GzipFile(fileobj=file),
    "bz2": bz2.BZ2File,
    "xz": lzma.LZMAFile,
    "zst": lambda file: zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True),
}


def _store(file: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", file))


class Section(io.RawIOBase):
    """A part of a stored file, read as if it were a file of its own."""

    def __init__(self, source, first: int, size: int):
        self.source, self.first, self.size, self.at = source, first, size, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence]
        if at < 0:
            raise OSError("seek before the first byte")
        self.at = at
        return at

    def readinto(self, buffer) -> int:
        data = self.source.read_at(max(0, min(len(buffer), self.size - self.at)), self.first + self.at)
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)


@functools.lru_cache(maxsize=4)
def _pack(file: str):
    """An open pack; a task reads many sections of few packs."""
    store, inside = _store(file)
    return store.open_input_file(inside)


def open_place(place: str | bytes) -> io.BufferedReader | io.BytesIO:
    """A stored file, or the section of one that the place names, as a seekable stream; only what is read leaves the store.

    Bytes are a container that the task holds already.
    """
    if isinstance(place, bytes):
        return io.BytesIO(place)
    file, _, section = place.partition(SECTION)
    if not section:
        store, inside = _store(file)
        return io.BufferedReader(store.open_input_file(inside), BUFFER_BYTES)
    first, size = map(int, section.split("+"))
    if size <= BUFFER_BYTES:
        return io.BytesIO(_pack(file).read_at(size, first))
    return io.BufferedReader(Section(_pack(file), first, size), BUFFER_BYTES)


class Pack:
    """A stored file of many streams, one behind another, so that a task that keeps a million of them makes one file.

    It is made with the first stream, and its places can be opened once it is closed.
    """

    def __init__(self, folder: str):
        self.folder, self.file, self.out, self.at = folder, None, None, 0

    def save(self, source, most: int | None = None, head: bytes = b"") -> tuple[str, int] | None:
        """Copy a stream, of which ``head`` was read; its place and size, or None once it has more than ``most`` bytes.

        Places of one pack sort as they lie in it, and no two are equal: an empty stream takes a byte that is none of its own.
        """
        if self.out is None:
            self.file = f"{self.folder}/{uuid.uuid4().hex}"
            store, inside = _store(self.file)
            store.create_dir(inside.rpartition("/")[0], recursive=True)
            self.out = store.open_output_stream(inside)
        first, piece = self.at, head or source.read(CHUNK_BYTES)
        while piece:
            if most is not None and self.at - first + len(piece) > most:
                return None
            self.out.write(piece)
            self.at += len(piece)
            piece = source.read(CHUNK_BYTES)
        size = self.at - first
        if not size:
            self.out.write(b"\0")
            self.at += 1
        return f"{self.file}{SECTION}{first:015d}+{size}", size

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def heads_of(place: str | bytes, size: int, inner: int = 512) -> tuple[bytes, bytes | None]:
    """The first bytes of a stored file, none when it cannot be opened, and the first decompressed ones of a compressed stream."""
    try:
        with open_place(place) as file:
            head = file.read(size)
            lead = head[:8].hex().upper()
            how = next((fmt for magic, fmt in STREAM_MAGIC if lead.startswith(magic)), None)
            file.seek(0)
            return head, stream_head(file, how, inner) if how else None
    except OSError:
        return b"", None


def is_tar_block(block: bytes) -> bool:
    """``ustar`` at byte 257, or an octal checksum equal to the byte sum, in a whole block."""
    if len(block) < 512:
        return False
    if block[257:262] == b"ustar":
        return True
    stored = block[148:156].strip(b"\0 ")
    return bool(re.match(rb"[+]?[0-7]+$", stored)) and int(stored, 8) == sum(block[:148]) + 8 * 32 + sum(block[156:512])


def format_of(place: str | bytes, name: str) -> tuple[str, bytes]:
    """Format of a stored container by the rules of the column ``detect_format``, and its first bytes."""
    head, inner = heads_of(place, SAMPLE_BYTES)
    lead, lowered = head[:8].hex().upper(), name.lower()
    found = next((fmt for magic, fmt in MAGIC if lead.startswith(magic)), None)
    if found or is_tar_block(head[:512]):
        return found or "tar", head
    named = next((fmt for suffix, fmt in ARCHIVE_SUFFIXES if lowered.endswith(suffix)), None)
    stream = next((fmt for magic, fmt in STREAM_MAGIC if lead.startswith(magic)), None)
    if stream is None:
        return ("tar" if named == "tar" and head[:512] == bytes(512) else "plain"), head
    holds = inner is not None and (is_tar_block(inner) or named == f"tar.{stream}" and inner == bytes(512))
    return (f"tar.{stream}" if holds else stream), head


def is_text(head: bytes) -> bool:
    """Text by sample, by the rule of the column ``is_text_sample``."""
    return not head or 0 not in head and (len(head) - len(head.translate(None, CONTROL))) / len(head) < 0.10


def read_upto(source, size: int) -> bytes:
    """So many bytes of a stream, fewer only at its end."""
    data = b""
    while len(data) < size and (more := source.read(size - len(data))):
        data += more
    return data


class OverLimit(ValueError):
    """An entry, or what was read so far, is larger than the limit."""

    def __init__(self):
        super().__init__("decoded size limit exceeded")


class LimitedReader(io.RawIOBase):
    """Reader that fails once more than ``limit`` bytes went through."""

    def __init__(self, source, limit: int, what: str):
        self.source, self.left, self.what = source, limit, what

    def readable(self) -> bool:
        return True

    def read(self, size: int = -1) -> bytes:
        data = self.source.read(size if size >= 0 else self.left + 1)
        self.left -= len(data)
        if self.left < 0:
            raise ValueError(f"{self.what} limit exceeded")
        return data


def stream_head(file, compression: str, size: int = 512) -> bytes | None:
    """First decompressed bytes, None when the stream cannot be read."""
    try:
        return read_upto(OPENERS[compression](file), size)
    except Exception:  # damaged streams come in every shape
        return None


def gzip_name(data: bytes) -> str | None:
    """Original file name stored in a gzip header, given the first bytes, without directories."""
    if len(data) < 10 or not data[3] & 8:
        return None
    start = 10
    if data[3] & 4:
        start += 2 + int.from_bytes(data[10:12], "little")
    end = data.find(b"\0", start)
    try:
        name = data[start:end].decode("utf-8") if end > start else ""
    except UnicodeDecodeError:
        return None
    return name.rsplit("/", 1)[-1] or None


class Entry:
    """One raw entry and a way to open it; ``lines`` opens one of a ZIP at its own header."""

    def __init__(self, name: str, size: int, regular: bool, encrypted: bool, opener, lines=None):
        self.name, self.size, self.regular, self.encrypted, self.open, self.lines = name, size, regular, encrypted, opener, lines or opener


def zip_entries(file, limits: ArchiveLimits) -> Iterator[Entry]:
    """Entries of a ZIP from its central directory; nothing is decompressed."""
    archive = zipfile.ZipFile(file)
    if len(archive.infolist()) > limits.max_entries:
        raise ValueError("entry count limit exceeded")
    for info in archive.infolist():
        lines = functools.partial(open_member, file, info.filename, info.header_offset, info.compress_size, info.file_size, info.CRC, info.compress_type)
        yield Entry(info.filename, info.file_size, is_regular_member(info), bool(info.flag_bits & 1), lambda i=info: archive.open(i), lines)


def is_regular_member(info: zipfile.ZipInfo) -> bool:
    """Is a ZIP entry a file, and no directory or link?"""
    return not info.is_dir() and stat.S_IFMT(info.external_attr >> 16) in (0, stat.S_IFREG)


def zip_members(file, limits: ArchiveLimits) -> Iterator[zipfile.ZipInfo]:
    """The records of a ZIP's central directory."""
    for count, info in enumerate(zipfile.ZipFile(file).infolist()):
        if count >= limits.max_entries:
            raise ValueError("entry count limit exceeded")
        yield info


def open_member(file, name: str, offset: int, packed: int, size: int, crc: int, method: int):
    """One entry of a ZIP as a stream, opened at its own header; nothing else of the file is read."""
    file.seek(offset)
    header = file.read(30)
    if len(header) < 30 or header[:4] != b"PK\x03\x04":
        raise ValueError("no entry where the central directory says")
    file.seek(offset + 30 + int.from_bytes(header[26:28], "little") + int.from_bytes(header[28:30], "little"))
    info = zipfile.ZipInfo(name)
    info.header_offset, info.compress_size, info.file_size = offset, packed, size
    info.CRC, info.compress_type = crc, method
    return zipfile.ZipExtFile(file, "r", info)


def tar_entries(file, compression: str | None, limits: ArchiveLimits) -> Iterator[Entry]:
    """Entries of a TAR in stream order; each must be read before the next."""
    source = OPENERS[compression](file) if compression else file
    limited = LimitedReader(source, limits.max_scan_bytes, "scan size")
    archive = tarfile.open(fileobj=limited, mode="r|")
    for info in archive:
        yield Entry(info.name.replace("\\", "/"), info.size, info.isreg(), False, lambda i=info: archive.extractfile(i))


def entries_of(place: str | bytes, fmt: str, name: str, limits: ArchiveLimits) -> Iterator[Entry]:
    """Raw entries of a stored container, or the one entry of a compressed or plain file."""
    with open_place(place) as file:
        if fmt == "zip":
            found = zip_entries(file, limits)
        elif fmt == "tar" or fmt.startswith("tar."):
            found = tar_entries(file, fmt[4:] or None, limits)
        elif fmt in OPENERS or fmt == "plain":
            found = iter([single_entry(file, fmt, name)])
        else:
            raise ValueError(f"unsupported format {fmt}")
        for count, entry in enumerate(found):
            if count >= limits.max_entries:
                raise ValueError("entry count limit exceeded")
            yield entry


def single_entry(file, fmt: str, name: str) -> Entry:
    """What a compressed stream or a plain file holds."""
    size = file.seek(0, io.SEEK_END)
    file.seek(0)
    if fmt == "plain":
        return Entry(name, size, True, False, lambda: file)
    stem = name.rsplit(".", 1)[0] if "." in name[1:] else name
    inner = (gzip_name(file.read(HEADER_BYTES)) if fmt == "gz" else None) or stem or "log"
    file.seek(0)
    if stream_head(file, fmt, 1) is None:
        raise ValueError(f"damaged {fmt} stream")
    file.seek(0)
    return Entry(inner, size, True, False, lambda: OPENERS[fmt](file))


def sample_charset(head: bytes) -> str:
    """Charset of the first bytes of an entry, by the same rule as the column."""
    if head.startswith(b"\xef\xbb\xbf"):
        return "UTF-8"
    if head.startswith(b"\xff\xfe"):
        return "UTF-16LE"
    if head.startswith(b"\xfe\xff"):
        return "UTF-16BE"
    for cut in range(4 if len(head) == SAMPLE_BYTES else 1):
        try:
            head[: len(head) - cut].decode("utf-8")
            return "UTF-8"
        except UnicodeDecodeError:
            continue
    return "GB18030"


def line_chunks(source, charset: str, max_line: int, head: bytes = b"", left: int | None = None) -> Iterator[tuple[int, int, bytes, bool]]:
    """``(first line number, bytes read, chunk, cut)`` pieces of a byte stream.

    A chunk holds whole lines, so it can be decoded and split on its own.  A line
    longer than ``max_line`` bytes, its end included, is a chunk by itself, cut
    to that length.  Line ends of UTF-16 are two bytes wide and aligned.
    An unfinished line doubles what is read next, so its bytes are looked at
    about twice however long it is.  More than ``left`` bytes are refused.
    """
    unit = {"UTF-16LE": "<u2", "UTF-16BE": ">u2"}.get(charset, "u1")
    width, number, rest, skipped = np.dtype(unit).itemsize, 1, b"", 0
    data, seen = head or source.read(CHUNK_BYTES), 0
    while data:
        seen += len(data)
        data = rest + data
        if width == 1 and not skipped and len(data) <= max_line:
            # No line in here is overlong, so nothing is cut.
            end = data.rfind(b"\n", len(rest)) + 1
            if end:
                yield number, end, data[:end], False
                number += data.count(b"\n", 0, end)
            rest = data[end:]
            if left is not None and seen > left:
                raise OverLimit
            data = source.read(max(CHUNK_BYTES, len(rest)))
            continue
        whole = len(data) - len(data) % width
        ends = (np.flatnonzero(np.frombuffer(data[:whole], unit) == 10) + 1) * width
        starts = np.concatenate(([0], ends))
        lengths = np.diff(starts)
        if len(lengths) and skipped:
            lengths[0] += skipped
        begin = 0
        for i in np.flatnonzero(lengths > max_line):
            if starts[i] > starts[begin]:
                piece = data[starts[begin] : starts[i]]
                yield number, len(piece), piece, False
                number += int(i) - begin
            yield number, int(lengths[i]), data[starts[i] : starts[i] + max_line], True
            number, begin = number + 1, int(i) + 1
        if starts[-1] > starts[begin]:
            piece = data[starts[begin] : starts[-1]]
            yield number, len(piece), piece, False
            number += len(lengths) - begin
        if len(lengths):
            skipped = 0
        # What follows the last line end; of an overlong line only the kept part.
        rest = data[starts[-1] :]
        keep = max_line + max_line % width
        if len(rest) > keep + CHUNK_BYTES:
            surplus = len(rest) - keep - (len(rest) - keep) % width
            odd = rest[keep + surplus :]
            rest, skipped = rest[:keep] + odd, skipped + surplus
        if left is not None and seen > left:
            raise OverLimit
        data = source.read(max(CHUNK_BYTES, len(rest)))
    length = len(rest) + skipped
    if length:
        yield number, length, rest[:max_line], length > max_line
