"""Path columns: names, parents, keys, depth, ancestors, containment.

All functions take and return Columns, so they stay inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = r"[/\\]"


def file_name(path: Column) -> Column:
    """Last component of a path."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def parent_dir(path: Column) -> Column:
    """Path without its last component."""
    return F.regexp_replace(path, r"[/\\][^/\\]*$", "")


def extension(name: Column) -> Column:
    """Lower-cased last extension; a leading-dot name has none."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def file_stem(name: Column) -> Column:
    """Name without its last extension, ``log`` when nothing is left."""
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.nullif(stem, F.lit("")), F.lit("log"))


def is_windows(path: Column) -> Column:
    """Does the path begin with a drive letter?"""
    return path.rlike(r"^[A-Za-z]:[/\\]")


def path_key(path: Column) -> Column:
    """Identity of a path: drive-letter paths ignore case and slash direction."""
    return F.when(is_windows(path), F.lower(F.replace(path, F.lit("/"), F.lit("\\")))).otherwise(path)


def comparable(path: Column) -> Column:
    """Slash-only form used for containment tests."""
    slashed = F.regexp_replace(path, r"[/\\]+", "/")
    # A trailing slash goes unless it is all there is, or all that follows a drive.
    trimmed = F.regexp_replace(slashed, "(?<!^[A-Za-z]:)(?<!^)/$", "")
    return F.when(is_windows(path), F.lower(trimmed)).otherwise(trimmed)


def same_path(left: Column, right: Column) -> Column:
    """Do two spellings name the same file?"""
    return (is_windows(left) == is_windows(right)) & (comparable(left) == comparable(right))


def depth(path: Column) -> Column:
    """Number of non-empty components."""
    return F.size(F.filter(F.split(path, SEPARATORS), lambda part: part != ""))


def within(key: Column, root_key: Column) -> Column:
    """Is a comparable path equal to, or below, a comparable root?"""
    prefix = F.when(F.endswith(root_key, F.lit("/")), root_key).otherwise(F.concat(root_key, F.lit("/")))
    return (key == root_key) | F.startswith(key, prefix)


def strictly_within(key: Column, root_key: Column) -> Column:
    """Is a comparable path below, but not equal to, a comparable root?"""
    return (key != root_key) & within(key, root_key)


def ancestor_keys(key: Column) -> Column:
    """All comparable prefixes of a comparable path, the path itself last."""
    anchor = F.regexp_extract(key, r"^([a-z]:)?/", 0)
    parts = F.filter(F.split(F.substr(key, F.length(anchor) + 1), "/"), lambda part: part != "")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.concat(anchor, F.array_join(F.slice(parts, F.lit(1), i), "/")),
    )
    below = F.when(F.size(parts) > 0, prefixes).otherwise(F.array().cast("array<string>"))
    return F.when(anchor != "", F.concat(F.array(anchor), below)).otherwise(below)


def directory_chain(root: Column, path: Column) -> Column:
    """Directories to open from ``root`` down to the parent of ``path``.

    Empty when the path is the root or lies outside it; keeps the root's
    spelling and the separator of its platform.
    """
    slashed_root = F.regexp_replace(F.regexp_replace(root, r"[/\\]+", "/"), "(?<=[^/:])/$", "")
    slashed = F.regexp_replace(F.regexp_replace(path, r"[/\\]+", "/"), "(?<=[^/:])/$", "")
    rest = F.substr(slashed, F.length(slashed_root) + 1)
    parts = F.filter(F.split(rest, "/"), lambda part: part != "")
    dirs = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    sep = F.when(is_windows(root), F.lit("\\")).otherwise(F.lit("/"))
    base = F.when(root.rlike(r"[/\\]$"), root).otherwise(F.concat(root, sep))
    # array_join takes a constant separator, so join with "/" and translate.
    chain = F.transform(
        F.sequence(F.lit(1), F.size(dirs)),
        lambda i: F.concat(base, F.replace(F.array_join(F.slice(dirs, F.lit(1), i), "/"), F.lit("/"), sep)),
    )
    full = F.when(F.size(dirs) > 0, F.concat(F.array(root), chain)).otherwise(F.array(root))
    inside = (is_windows(root) == is_windows(path)) & strictly_within(comparable(path), comparable(root))
    return F.when(inside, full).otherwise(F.array().cast("array<string>"))


def user_facing(path: Column) -> Column:
    r"""Drop the verbatim prefixes ``\\?\UNC\`` and ``\\?\``."""
    unc = F.regexp_replace(path, r"^\\\\\?\\UNC\\", r"\\\\")
    return F.regexp_replace(unc, r"^\\\\\?\\", "")


def entry_source(key: Column) -> Column:
    """Outer file of an entry key ``outer::inner::entry``."""
    return F.element_at(F.split(key, "::"), 1)


def entry_title(key: Column) -> Column:
    """Last path component of what follows the outer file."""
    return file_name(F.regexp_replace(key, "^.*?::", ""))


def entry_archive(key: Column) -> Column:
    """Archive holding the innermost part; a plain file holds itself."""
    parts = F.split(key, "::")
    return F.when(
        F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "::")
    ).otherwise(key)


def entry_chain(key: Column) -> Column:
    """Containers between the outer file and the innermost part."""
    parts = F.split(key, "::")
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))


def breadcrumb(key: Column) -> Column:
    """``archive › inner › entry``: archives by name, the entry by its path."""
    parts = F.split(key, "::")
    shown = F.transform(parts, lambda part, i: F.when(i == 0, file_name(part)).otherwise(part))
    return F.when(F.size(parts) > 1, F.array_join(shown, " › ")).otherwise(key)
