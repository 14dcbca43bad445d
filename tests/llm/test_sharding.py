import hashlib
import random

from corpora import documents, odd_rows  # noqa: F401
from logquarry.llm.sharding import extendible_shards


def plain(rows, limit):
    """Recursive splitting of unique keys by their hash bits."""
    def path(key):
        return f"{int(hashlib.md5(str(key).encode()).hexdigest()[:15], 16):060b}"

    out = {}

    def split(part, depth):
        size = sum(b for _, b in part)
        if not part:
            return
        if size <= limit or len(part) == 1:
            for key, b in part:
                out[key] = (b, path(key)[:depth], size, len(part))
            return
        for bit in "01":
            split([(k, b) for k, b in part if path(k)[depth] == bit], depth + 1)

    split([(k, len((t or "").encode())) for k, t in rows], 0)
    return out


def test_against_brute_force(documents):
    rng = random.Random(10)
    rows = [(i, "é" * int(rng.expovariate(1 / 40))) for i in range(700)] + [(1000, "x" * 50_000), (1001, None)]
    for limit in (200, 3_000, 10**9):
        got = {r.doc_id: tuple(r)[1:] for r in extendible_shards(documents(rows), max_bytes=limit).collect()}
        assert got == plain(rows, limit)


def test_a_hot_key_is_many_shards(documents):
    rows = [(7, "x" * 100)] * 300 + [(i, "y" * 10) for i in range(8, 40)]
    got = extendible_shards(documents(rows), max_bytes=1_000).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.bytes
        assert r.shard_bytes <= 1_000
    assert all(sizes[r.shard] == r.shard_bytes for r in got)
    names = sorted(sizes)
    assert all(not b.startswith(a) for a, b in zip(names, names[1:], strict=False))


def test_odd_rows(documents, odd_rows):
    for limit in (60, 1 << 20):
        got = extendible_shards(documents(odd_rows), max_bytes=limit).collect()
        assert sorted((r.doc_id, r.bytes) for r in got if r.doc_id is not None) == sorted(
            (i, len((t or "").encode())) for i, t in odd_rows if i is not None
        )
        assert len(got) == len(odd_rows)
        assert all(r.shard_bytes <= limit or r.shard_rows == 1 for r in got)
    assert extendible_shards(documents([])).collect() == []
