import random
import re

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corpora import documents, odd_rows  # noqa: F401
from logquarry.llm.simhash import BKTree, drop_near_copies, fingerprint, links, simhash_components


def plain(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(prints, radius=3):
    """The smallest index that links lead to, for each print."""
    root = list(range(len(prints)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(prints))]


@given(st.text(alphabet="aAbÉ \t\n\x0b\x1c\xa0é", max_size=60))
def test_fingerprint(text):
    assert fingerprint(text) == plain(text)


@given(st.lists(st.integers(0, 2**64 - 1), max_size=40), st.integers(0, 20))
@settings(max_examples=50)
def test_tree_finds_all_within_radius(values, radius):
    tree = BKTree()
    for v in values:
        tree.add(v)
    for v in values[:5]:
        assert set(tree.within(v, radius)) == {w for w in values if (v ^ w).bit_count() <= radius}


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(60)}
    # Chains, and a crowd that shares most of its blocks, which small shards must split again.
    for p in list(prints)[:20]:
        prints.add(p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    base = rng.getrandbits(64) & ~0xFFFF
    prints |= {base | rng.getrandbits(16) for _ in range(80)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    expected = groups(prints)
    for most in (256, 3):
        found = [(r.a, r.b) for r in links(df, 3, most).collect()]
        root = {p: p for p in signed}

        def top(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in found:
            assert ((a ^ b) & (2**64 - 1)).bit_count() <= 3
            root[top(a)] = top(b)
        seen = {}
        for p, e in zip(signed, expected, strict=True):
            assert seen.setdefault(top(p), e) == e
        assert len(seen) == len(set(expected))


def test_odd_rows(documents, odd_rows):
    got = sorted(simhash_components(documents(odd_rows)).collect(), key=repr)
    assert len(got) == len(odd_rows)
    prints = [plain(t) for _, t in odd_rows]
    roots = groups(prints)
    expected = []
    for (i, _), p, r in zip(odd_rows, prints, roots, strict=True):
        ids = [j for (j, _), s in zip(odd_rows, roots, strict=True) if s == r and j is not None]
        expected.append((i, f"{p:016x}", min(ids, default=None)))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    kept = drop_near_copies(documents(odd_rows))
    assert kept.columns == documents(odd_rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([None, None, 1, 4, 5, 5, 7, 8, -10], key=repr)


def test_empty_table(documents):
    assert simhash_components(documents([])).collect() == []
    assert drop_near_copies(documents([])).collect() == []
