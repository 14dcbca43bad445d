"""Block-Max MaxScore against scoring every document, and the parts of the index against their definitions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from corpora import documents, odd_rows  # noqa: F401
from logquarry.llm import lexical
from logquarry.llm.lexical import Best, Shard, build_index, impacts, norms, ranked_search, search_index, search_shard, shard_row, terms_of

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(WORD, text or "")]


def plain(docs, items, k=20):
    """``{(item_id, text): [(rank, doc_id, score)]}`` by the definition."""
    held = [(i, Counter(words_of(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    many, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = {}
    for item, text in set(items):
        asked = Counter(words_of(text))
        weight = {t: math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) for t in asked if t in df}
        rows = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * many // total
            score = sum(n * weight[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, n in asked.items() if t in c)
            if score > 0:
                rows.append((i, score))
        rows.sort(key=lambda r: (-r[1], r[0] is not None, r[0] or 0))
        out[item, text] = [(rank, i, s) for rank, (i, s) in enumerate(rows[:k], 1)]
    return out


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 120)))) for i in range(n)]
    # A group of copies, whose scores tie.
    return docs + [(n + i, docs[0][1]) for i in range(60)]


def items_of(spark, rows):
    df = spark.createDataFrame(rows, "item_id long, text string")
    return df.selectExpr("*", "cast(null as string) AS term", "cast(null as string) AS score", "1 AS rank", "2 AS doc_id")


def check(spark, documents, docs, items, k=20):
    got = ranked_search(documents(docs), items_of(spark, items), k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    expected = [(item, *row) for (item, _), rows in plain(docs, items, k).items() for row in rows]
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected, key=key)


def test_against_every_document(spark, documents, monkeypatch):
    rng = random.Random(3)
    docs = corpus(rng, 1500)
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices([f"W{j}" for j in range(320)], k=rng.randint(1, 30)))) for i in range(40)]
    items += [(50, docs[0][1]), (51, "w0 w0 w0 w1"), (52, "nowhere"), (53, "w299")]
    check(spark, documents, docs, items)
    check(spark, documents, docs, items[:5], k=1)
    # Many small shards in a task, which pass their thresholds on, and blocks of queries.
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", 500)
    index = build_index(documents(docs).coalesce(1))
    got = search_index(index, items_of(spark, items), query_bytes=1000).collect()
    expected = [(item, *row) for (item, _), rows in plain(docs, items).items() for row in rows]
    assert sorted(map(tuple, got)) == sorted(expected)


def test_index_is_written_in_small_row_groups(spark, documents, monkeypatch):
    """A task that writes or reads a file of many shards holds a few of them, not all."""
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", 1000)
    monkeypatch.setattr(lexical, "GROUP_BYTES", 200_000, raising=False)
    rng = random.Random(7)
    docs = [(i, " ".join(f"{rng.getrandbits(64):x}" for _ in range(1000))) for i in range(90)]
    (file,) = build_index(documents(docs).coalesce(1)).inputFiles()
    written = pq.ParquetFile(file.removeprefix("file://")).metadata
    groups = [written.row_group(i) for i in range(written.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 90
    # Parquet goes by compressed bytes; these are not, and are 3.4 MB for all shards.
    assert max(g.total_byte_size for g in groups) < 500_000


def test_blocks_are_rejected_unread():
    """A list that all documents share is not unpacked where its blocks cannot help."""
    counts = [{b"common": 1, b"rare" if i % 50 == 0 else b"x%d" % i: 20 if i < 250 else 1} for i in range(5000)]
    shard = Shard(row_of(counts), 10**6, 10**7)
    best = Best(5)
    search_shard(shard, [(b"common", 10), (b"rare", 9000)], best)
    total = shard.first[shard.lists[b"common"] + 1] - shard.first[shard.lists[b"common"]]
    common = [n for n in shard.held if shard.first[shard.lists[b"common"]] <= n < shard.first[shard.lists[b"common"]] + total]
    assert total == 40 and len(common) <= 2
    assert [r[2] for r in best.rows] == [0, 50] + [100, 150, 200]


def row_of(counts):
    lengths = [sum(c.values()) for c in counts]
    names = ["docs", "total", "terms", "df", "lengths", "last", "edges", "offsets", "payload"]
    return dict(zip(names, shard_row(counts, lengths), strict=True)) | {"ids": list(range(len(counts)))}


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.integers(1, 6))
def test_index_gives_back_postings_and_exact_block_maxima(seed, docs, vocabulary):
    rng = random.Random(seed)
    counts = [{b"t%d" % t: rng.randint(1, 30) for t in rng.sample(range(vocabulary), rng.randint(1, vocabulary))} for _ in range(docs)]
    shard = Shard(row_of(counts), 1000 * docs, 20_000 * docs)
    length = np.array([sum(c.values()) for c in counts])
    norm = norms(length, 1000 * docs, 20_000 * docs)
    assert norm.tolist() == [75 + 25 * int(n) * 1000 * docs // (20_000 * docs) for n in length]
    for term, i in shard.lists.items():
        found = []
        for number in range(shard.first[i], shard.first[i + 1]):
            places, impact = shard.block(number)
            assert impact.max() == shard.most[number] and places[-1] == shard.last[number] and len(places) <= lexical.BLOCK
            found += zip(places.tolist(), impact.tolist(), strict=True)
        tf = np.array([c.get(term, 0) for c in counts])
        assert found == [(d, int(impacts(tf[d], norm[d]))) for d in np.flatnonzero(tf).tolist()]


@given(st.text(max_size=60))
def test_terms(text):
    text = text.encode("utf-8", "ignore").decode()
    assert [t.decode() for t in terms_of(text.encode())] == words_of(text)


def test_odd_rows(spark, documents, odd_rows):
    items = [(1, "one two THREE été"), (1, "one two THREE été"), (1, "seven"), (None, "alpha idiot"), (2, None), (3, ""), (4, " -- "), (5, "日本語 end ß"), (6, "x" * 100_000), (7, "delta " * 5000)]
    check(spark, documents, odd_rows, items)
    check(spark, documents, [], items)
    check(spark, documents, odd_rows, [])
    check(spark, documents, [(1, None), (2, "")], items)
