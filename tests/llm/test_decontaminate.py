import random
import re

import pytest

from corpora import documents, odd_rows  # noqa: F401
from logquarry.llm.decontaminate import Block, benchmark_overlaps, codes_of, drop_contaminated


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain(docs, items, share=0.8):
    """Best and then earliest place of each item that agrees in ``share`` of its words."""
    out = []
    cut = [(i, words(item)) for i, item in items]
    for d, text in docs:
        w = words(text)
        known = set(w)
        for i, v in cut:
            if len(v) < 5 or sum(x in known for x in v) < share * len(v):
                continue
            best = None
            for at in range(-len(v) // 2, len(w)):
                same = sum(0 <= at + k < len(w) and w[at + k] == x for k, x in enumerate(v))
                if same >= share * len(v) and (best is None or same > best[1]):
                    best = (at, same)
            if best:
                out.append((d, i, best[0], len(v), best[1]))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 40)))) for i in range(30)]
    items += [(90, "too few words"), (91, None), (92, ""), (93, items[0][1])]
    docs = []
    for i in range(150):
        text = rng.choices(vocabulary, k=rng.randint(0, 80))
        if i % 3:
            passage = words(items[rng.randrange(30)][1])
            changed = rng.sample(range(len(passage)), rng.randint(0, len(passage) // 4))
            passage = [f"x{p}" if p in changed else w for p, w in enumerate(passage)]
            at = rng.randint(0, len(text))
            cut = rng.choice([0, 0, 0, len(passage) // 8])
            text = text[:at] + passage + text[at:] if not cut else passage[cut:] + text
        docs.append((i, ", ".join(text).upper() if i % 2 else " ".join(text)))
    return docs, items


@pytest.mark.parametrize("block_words", [2_000_000, 200])
def test_against_brute_force(spark, documents, corpus, block_words):
    docs, items = corpus
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = benchmark_overlaps(documents(docs), bench, block_words=block_words)
    got = [tuple(r) for r in found.collect()]
    assert len(got) > 50
    assert sorted(got, key=repr) == plain(docs, items)


def test_every_pattern_of_replaced_words_is_found():
    from itertools import combinations

    for size in range(5, 21):
        item = [f"w{i}" for i in range(size)]
        block = Block.of([(0, " ".join(item))])
        for gone in combinations(range(size), size // 5):
            codes = codes_of(" ".join("x" if i in gone else w for i, w in enumerate(item)))
            starts, _ = block.alignments(codes)
            assert 0 in starts, (size, gone)


def test_odd_rows(spark, documents, odd_rows):
    prose = dict(odd_rows)[5]
    bench = spark.createDataFrame([(1, prose), (1, prose), (2, None)], "item_id int, text string")
    bench = bench.selectExpr("*", "1 as doc", "2 as block", "3 as item")
    got = benchmark_overlaps(documents(odd_rows), bench)
    assert dict(got.dtypes)["item_id"] == "int"
    assert sorted((tuple(r)[:2] for r in got.collect()), key=repr) == sorted([(i, 1) for i in (None, 5, 5, 6, 9)] * 2, key=repr)
    kept = drop_contaminated(documents(odd_rows), bench)
    assert kept.columns == documents(odd_rows).columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 7, 8, -10}


def test_empty_tables(spark, documents, odd_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert benchmark_overlaps(documents(odd_rows), none).collect() == []
    assert drop_contaminated(documents(odd_rows), none).count() == len(odd_rows)
    assert benchmark_overlaps(documents([]), none).collect() == []


def test_short_items_are_looked_up_whole(spark, documents):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocabulary, k=1 + i % 4))) for i in range(24)] + [(50, "W1, w2"), (51, " - "), (52, None)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 12)))) for i in range(80)] + [(90, None), (91, "w3")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = []
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            at = next((k for k in range(len(w) - len(v) + 1) if v and w[k : k + len(v)] == v), None)
            if at is not None:
                expected.append((d, i, at, len(v), len(v)))
    assert sorted(tuple(r) for r in benchmark_overlaps(documents(docs), bench).collect()) == sorted(expected)
    assert benchmark_overlaps(documents(docs), bench, short_items=False).collect() == []
    # Clean text holds short items too, so they drop nothing unless asked to.
    assert drop_contaminated(documents(docs), bench).count() == len(docs)
    assert drop_contaminated(documents(docs), bench, short_items=True).count() == len(docs) - len({e[0] for e in expected})
