"""Directory walks against the standard library's, with links, hidden names and directories that cannot be listed."""

import os

from logquarry.constants import PLATFORM_SKIPPED
from logquarry.functions.paths import comparable
from logquarry.sources import walk as W
from logquarry.sources.files import scan, scan_counted


def build(top):
    for path in ("a/b/c", ".hidden/_private", "skip/inner", "deep/" + "/".join("xyz"), "empty"):
        (top / path).mkdir(parents=True)
    for path in ("one.log", "a/two.log", "a/b/c/three.log", ".hidden/.four.log", ".hidden/_private/_five", "skip/six.log", "skip/inner/seven.log", "deep/x/y/z/eight.gz", "日志.log"):
        (top / path).write_bytes(path.encode())
    os.symlink(top / "a", top / "link_to_dir")
    os.symlink(top / "one.log", top / "link.log")
    os.symlink(top / "missing", top / "broken")
    os.symlink(top, top / "a" / "loop")


def plain(top, skip=()):
    out = {}
    for folder, dirs, files in os.walk(top):
        dirs[:] = [d for d in dirs if os.path.join(folder, d) not in skip]
        for name in files:
            path = os.path.join(folder, name)
            if not os.path.islink(path):
                out[path] = os.path.getsize(path)
    return out


def test_hidden_names_are_found_and_links_not_followed(spark, tmp_path):
    build(tmp_path)
    found = W.walk(spark, [str(tmp_path)])
    rows = found.files.collect()
    assert {r.path: r.size for r in rows} == plain(tmp_path) and len(rows) == 9
    assert all(r.modified is not None for r in rows)
    folders = sum(1 for _ in os.walk(tmp_path))
    assert found.counts == {"directories": folders, "files": 9, "skipped_directories": 0}


def test_exclusions_and_roots_within_roots(spark, tmp_path):
    build(tmp_path)
    top = str(tmp_path)
    expected = plain(tmp_path, skip=(f"{top}/skip",))
    found = scan(spark, [top, f"{top}/a/", f"{top}/a/b", f"{top}/missing", f"{top}/one.log"], [f"{top}/skip"])
    rows = {r.path: r for r in found.collect()}
    assert {p: r.size for p, r in rows.items()} == expected and found.count() == len(expected)
    assert rows[f"{top}/a/two.log"].root == f"{top}/a/" and rows[f"{top}/a/b/c/three.log"].root == f"{top}/a/b"
    assert rows[f"{top}/deep/x/y/z/eight.gz"].is_archive and rows[f"{top}/日志.log"].is_log
    # An excluded file, and a root that is excluded itself.
    some = W.walk(spark, [top, f"{top}/skip/inner"], [f"{top}/skip", f"{top}/one.log"]).files
    assert {r.path for r in some.collect()} == set(expected) - {f"{top}/one.log"}
    assert W.walk(spark, [f"{top}/missing", " "]).files.collect() == []


def test_directories_that_cannot_be_listed_are_counted(spark, tmp_path, monkeypatch):
    build(tmp_path)
    (tmp_path / "gone").mkdir()
    assert [r[0] for r in W.list_directory(str(tmp_path / "nothing"))] == ["unreadable"]
    plain_listed = W._listed

    def vanish(frontier):
        # Between two levels a directory disappears.
        if (tmp_path / "gone").exists() and frontier.where(f"path = '{tmp_path}/gone'").count():
            (tmp_path / "gone").rmdir()
        return plain_listed(frontier)

    monkeypatch.setattr(W, "_listed", vanish)
    rows, counts = scan_counted(spark, [str(tmp_path)])
    assert counts["skipped_directories"] == 1 and rows.count() == 9
    assert counts["directories"] == sum(1 for _ in os.walk(tmp_path))


def test_platform_directories_and_other_stores(spark, tmp_path):
    build(tmp_path)
    assert {r.path for r in W.walk(spark, [f"file://{tmp_path}"]).files.select("path").collect()} == set(plain(tmp_path))
    assert any(comparable is not None for _ in PLATFORM_SKIPPED)
    # A walk of many directories is dealt over the tasks.
    for i in range(60):
        (tmp_path / f"many/d{i}").mkdir(parents=True)
        (tmp_path / f"many/d{i}/f.log").write_bytes(b"x")
    found = W.walk(spark, [str(tmp_path / "many")])
    assert found.files.count() == 60 and found.counts["directories"] == 61
