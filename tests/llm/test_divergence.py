"""Source divergence against its definition, with and without digests that collide."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpora import CLASHES
from logquarry.llm import divergence
from logquarry.llm.common import passing
from logquarry.llm.divergence import source_divergence, terms_of

WORD = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(WORD, text or "")]


def plain(rows, least=10, top=10):
    rows = [(lang or "", source or "", words_of(text)) for lang, source, text in rows]
    df, n, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, words in rows:
        sources[lang].add(source)
        df[lang].update(set(words))
        n[lang, source].update(words)
    out = []
    for lang, own in sources.items():
        kept = {t for t, d in df[lang].items() if d >= least}
        total = {s: sum(c for t, c in n[lang, s].items() if t in kept) for s in own}
        share = {s: {t: 1 + 10**9 * (n[lang, s][t] + 2) // (total[s] + 2 * len(kept)) for t in kept} for s in own}
        whole = {t: sum(n[lang, s][t] for s in own) for t in kept}
        q = {t: 1 + 10**9 * (whole[t] + 2) // (sum(total.values()) + 2 * len(kept)) for t in kept}
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(sum(gap(share[s][t], share[o][t]) for t in kept), o) for o in own - {s}]
            terms = [(gap(share[s][t], q[t]), t) for t in kept if n[lang, s][t] and share[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def make(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string")
    return df.selectExpr("*", *[f"cast(null as string) as `{c}`" for c in [*CLASHES, "term", "digest", "docs", "word", "slice", "a.b"] if c not in df.columns])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "abcdefghij" for b in ["x", "été", "Y", "zz", "日本"]]
    out = []
    for i in range(900):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["src0"] * 6 + [f"src{j}" for j in range(1, 8)] + [None])
        mine = words[: 10 + 40 * (i % 3 > 0)] + ["only" + (source or "").replace("src", "x")]
        out.append((lang, source, " ".join(rng.choices(mine, k=rng.randint(0, 40))) + (f" r{i}" if i % 2 else "")))
    # Languages of one document, of documents without terms, and of terms below the bound.
    return [*out, ("xx", "one", "alone"), ("yy", "a", None), ("yy", "b", "12 34"), ("zz", "a", "p q"), ("zz", "b", "p q"), *[("tie", "s", "k l m n o p q r s t u v")] * 12, ("tie", "t", "")]


def check(spark, rows, **options):
    got = source_divergence(make(spark, rows), **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows, options.get("least_docs", 10), options.get("top_terms", 10))


def test_against_brute_force(spark, rows):
    check(spark, rows)


@pytest.mark.parametrize("bits", [1, 4])
def test_digests_that_collide_are_split(spark, rows, bits):
    check(spark, rows, digest_bits=bits)


def test_other_bounds_and_tiles(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 3)
    monkeypatch.setattr(divergence, "WINDOW_PAIRS", 50)
    check(spark, rows, least_docs=1, top_terms=3)


def test_tiles_of_pairs(monkeypatch):
    """Every pair of sources, within a tile and across two, with tables that fill up in between."""
    monkeypatch.setattr(divergence, "DENSE_TERMS", 4)
    rng = np.random.default_rng(2)
    p = rng.integers(1, 10**9, (8, 30))
    base = rng.integers(1, 10**6, 8)
    p = np.where(rng.random(p.shape) < 0.5, p, base[:, None])
    found = {}
    for i in range(3):
        for j in range(i, 3):
            table = divergence.PairTable(i, j, 3)
            sides = np.array([s for s in range(8) if s // 3 in (i, j)])
            table.zeros(sides, base[sides])
            rows = [(t, s) for t in range(30) for s in sides.tolist() if p[s, t] != base[s]]
            # In batches that end anywhere.
            for low in range(0, len(rows), 7):
                t, at = (np.array(x) for x in zip(*rows[low : low + 7], strict=True))
                table.add(t, np.zeros(len(t), np.int64), at, p[at, t])
            schema = divergence.pa.schema([("lang_no", "int32"), ("a", "int32"), ("b", "int32"), ("value", "int64")])
            for batch in table.rows(0, schema):
                for r in batch.to_pylist():
                    assert (r["a"], r["b"]) not in found
                    found[r["a"], r["b"]] = r["value"]
    # Terms that neither uses give the flat value, which the sums leave out.
    for (a, b), value in found.items():
        used = (p[a] != base[a]) | (p[b] != base[b])
        flat = (int(base[a]) - int(base[b])) ** 2 // int(base[a] + base[b])
        expected = sum((int(x) - int(y)) ** 2 // int(x + y) - flat for x, y in zip(p[a][used], p[b][used], strict=True))
        assert value == expected
    assert sorted(found) == [(a, b) for a in range(8) for b in range(a + 1, 8)]


def test_the_filter_passes_all_kept_digests(spark):
    digests = [random.Random(i).randrange(-(2**63), 2**63) for i in range(2000)]
    every = spark.createDataFrame([(d,) for d in digests], "digest long")
    kept = spark.createDataFrame([(d,) for d in digests[:300]], "digest long")
    passed = {r.digest for r in passing(every, kept, "digest").collect()}
    assert set(digests[:300]) <= passed and len(passed) < 320


def test_odd_rows(spark):
    long = " ".join(["alpha", "Beta", "été"] * 30_000)
    odd = [(None, None, None), ("", "", ""), ("en", "s", long), ("en", None, long), ("en", "s", "\x00 alpha ퟿"), *[("en", "t", "beta " + "y" * 70_000)] * 10, ("en", "t", "ß\u0085É")]
    check(spark, odd, least_docs=1)
    check(spark, odd)
    assert source_divergence(make(spark, [])).collect() == []
    assert [t.decode() for t in terms_of("Aé1b_C d".encode())] == words_of("Aé1b_C d")
