import gzip

import pytest

from logquarry import api
from logquarry.queries.derived import make_zip
from logquarry.sources.files import observed, scan


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "logs"
    (root / "private" / "nested").mkdir(parents=True)
    (root / "app").mkdir()
    (root / "server.log").write_bytes(b"one\ntwo\n")
    (root / "image.bin").write_bytes(bytes([0, 1, 2, 3]))
    (root / "app" / "debug.log").write_bytes("中文\n".encode("gb18030"))
    (root / "app" / "old.log.gz").write_bytes(gzip.compress(b"x\ny\n"))
    (root / "download.part").write_bytes(make_zip({"in.log": b"1\n"}, False))
    (root / "private" / "nested" / "file.log").write_bytes(b"secret\n")
    return root


def test_catalog_life(spark, tree, tmp_path):
    store = api.open_catalog(spark, str(tmp_path / "catalog"))
    api.build_catalog(store, [str(tree)], [str(tree / "private"), str(tree / "private")])
    catalog = store.read()
    assert catalog.count() == 5
    status = api.catalog_status(catalog).first()
    assert (status.indexed_files, status.logs, status.archives) == (5, 2, 1)
    found = api.search(catalog, "debug")
    assert [r.name for r in found.items.collect()] == ["debug.log"] and found.stats.first().total == 1
    names = [(r.name, r.kind) for r in api.inventory(catalog, str(tree)).collect()]
    assert names == [("app", "dir"), ("download.part", "file"), ("image.bin", "file"), ("server.log", "file")]
    (tree / "app" / "debug.log").unlink()
    api.refresh_root(store, str(tree))
    assert store.read().count() == 5
    api.merge_catalog(store, scan(spark, [str(tree)]))
    assert store.read().count() == 5
    assert {r.name for r in api.watched(store.read(), [".log"]).collect()} == {"server.log", "old.log.gz", "file.log"}
    api.clear_catalog(store)
    assert store.read().count() == 0


def test_refresh_is_a_new_version(spark, tree, tmp_path):
    store = api.open_catalog(spark, str(tmp_path / "catalog"))
    api.build_catalog(store, [str(tree), str(tree / "app")])
    before, old = store.version(), store.read()
    names = {(r.name, r.root) for r in old.collect()}
    # A root inside another keeps its own files, and none is listed twice.
    api.refresh_root(store, str(tree))
    assert {(r.name, r.root) for r in store.read().collect()} == names and store.read().count() == len(names)
    for name in ("debug.log", "old.log.gz"):
        (tree / "app" / name).unlink()
    api.refresh_root(store, str(tree / "app"))
    assert {r.name for r in store.read().collect()} == {"server.log", "image.bin", "download.part", "file.log"}
    assert old.count() == len(names) and store.version() == before + 2


def test_lines_and_containers(spark, tree):
    table = api.lines(spark, str(tree / "server.log"))
    assert [r.content for r in api.read_lines(table, 1, 5).collect()] == ["two"]
    assert api.line_counts(table).first().n_lines == 2
    assert api.lines(spark, str(tree / "app" / "debug.log"), splittable=False).first().content == "中文"
    kinds = {r.path.split("/")[-1]: r.kind for r in api.classify(spark, str(tree)).collect()}
    assert kinds["download.part"] == "archive" and kinds["server.log"] == "file" and kinds["image.bin"] is None
    assert api.entries(spark, str(tree / "download.part")).first().entry_path == "in.log"
    assert api.entry_lines(spark, str(tree / "app" / "old.log.gz")).count() == 2
    paths = scan(spark, [str(tree)]).select("path")
    assert api.covered(paths, [str(tree)]).where("covered").count() == 6
    first = api.revisions(spark, [str(tree)]).where("path like '%server.log'").first()
    size, seconds, nanos = first.revision.split(":")
    assert size == "8" and int(seconds) > 10**9 and int(nanos) < 10**9


def test_scan_counts_itself(spark, tree):
    counted, seen = observed(scan(spark, [str(tree)]), "t")
    counted.write.format("noop").mode("overwrite").save()
    assert seen.get["indexed"] == 6 and seen.get["logs"] == 3


def test_export_of_a_published_prefix(spark, tree, tmp_path):
    facts = api.export_lines(api.lines(spark, str(tree / "server.log")), 1, str(tmp_path / "out")).first()
    assert (facts.n_lines, facts.bytes, facts.complete) == (1, 4, False)
