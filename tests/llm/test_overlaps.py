import random

import numpy as np
import pytest

from corpora import documents  # noqa: F401
from logquarry.llm.decontaminate import OVERLAP_WORDS, Block, benchmark_overlaps, codes_of, drop_contaminated

ITEM = [f"w{i}" for i in range(40)]
SHORT = [f"s{i}" for i in range(12)]
BEFORE, AFTER = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
PARTS = {
    "part": (ITEM[10:25], 1),
    "part with two replaced": ([*ITEM[10:13], "x", *ITEM[14:18], "y", *ITEM[19:23]], 1),
    "part at the end": (ITEM[:14], 1),
    "word put in": ([*ITEM[5:12], "x", *ITEM[12:18]], 1),
    "word left out": ([*ITEM[5:12], *ITEM[13:20]], 1),
    "whole shifted": ([*ITEM[:20], "x", *ITEM[20:]], 1),
    "short item with a word put in": ([*SHORT[:6], "x", *SHORT[6:]], 2),
    "short item with a word left out": ([*SHORT[:6], *SHORT[7:]], 2),
    "too short": (ITEM[10:20], None),
    "three of thirteen replaced": (["x" if i in (12, 16, 20) else w for i, w in enumerate(ITEM)][10:23], None),
}


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(ITEM)), (2, " ".join(SHORT))], "item_id long, text string")


def test_parts_and_shifted_items(documents, bench):
    rows = []
    for i, (passage, _) in enumerate(PARTS.values()):
        # Inside a text, at its very beginning and at its very end.
        rows += [(3 * i, " ".join(BEFORE + passage + AFTER)), (3 * i + 1, " ".join(passage + AFTER)), (3 * i + 2, " ".join(BEFORE + passage))]
    found = {r.doc_id: r for r in benchmark_overlaps(documents(rows), bench, overlap_words=OVERLAP_WORDS).collect()}
    expected = {3 * i + j: item for i, (_, item) in enumerate(PARTS.values()) for j in range(3) if item}
    assert {d: r.item_id for d, r in found.items()} == expected
    assert tuple(found[0])[2:] == (30, 15, 15) and tuple(found[1])[2:] == (0, 15, 15)
    assert tuple(found[3])[2:] == (30, 13, 11)
    assert tuple(found[9])[2:] == (30, 13, 13) and tuple(found[12])[2:] == (30, 15, 14)
    assert {r.doc_id for r in drop_contaminated(documents(rows), bench).collect()} == {i for i, _ in rows} - set(expected)


def plain(doc, item, words=OVERLAP_WORDS):
    """Whether some window of the item stands in the document, with one word put in or left out at most."""
    size = min(words, len(item))
    for at in range(len(item) - size + 1):
        part = item[at : at + size]
        for start in range(-size, len(doc)):
            for cut in range(size + 1):
                for shift in (-1, 0, 1):
                    pairs = [(start + i, i) for i in range(cut)] + [(start + i + shift, i) for i in range(cut + (shift < 0), size)]
                    if sum(0 <= p < len(doc) and doc[p] == part[i] for p, i in pairs) >= 0.8 * size:
                        return True
    return False


def plain_at_once(doc, item, words=OVERLAP_WORDS):
    """``plain`` for all windows and places of long texts at once."""
    size, m = min(words, len(item)), len(item)
    known = {w: i for i, w in enumerate(item)}
    first = np.array([known[w] for w in item])
    padded = np.array([-1] * (m + 2) + [known.get(w, -1) for w in doc] + [-1] * (m + 2))
    places = np.lib.stride_tricks.sliding_window_view(padded, m)
    sums = np.concatenate([np.zeros((len(places), 1), np.int64), np.cumsum(places == first, axis=1)], axis=1)
    windows = m - size + 1
    part = lambda rows, low, high: sums[rows, high : high + windows] - sums[rows, low : low + windows]
    here, on, back = slice(1, -1), slice(2, None), slice(None, -2)
    best = part(here, 0, size).max()
    for cut in range(size + 1):
        best = max(best, (part(here, 0, cut) + part(on, cut, size)).max())
        if cut < size:
            best = max(best, (part(here, 0, cut) + part(back, cut + 1, size)).max())
    return bool(best >= 0.8 * size)


def test_windows_against_brute_force():
    rng = random.Random(7)
    seen = [0, 0]
    for _ in range(150):
        item = rng.choices([f"w{i}" for i in range(40)], k=rng.randint(7, 20))
        doc = list(item)
        for at in rng.sample(range(len(doc)), rng.randint(0, 1)):
            doc[at] = "x"
        if rng.random() < 0.7:
            at = rng.randrange(len(doc))
            doc[at : at + 1] = rng.choice([[], [doc[at], "y"]])
        low = rng.choice([0, 0, len(doc) // 4, len(doc) // 3])
        doc = rng.choices(["p", "q", "w1", "w2"], k=3) + doc[low:]
        block, codes = Block.of([(0, " ".join(item))]), codes_of(" ".join(doc))
        hits = block.hits(codes)
        got = bool(list(block.parts(codes, np.array([0, len(codes)]), 0.8, OVERLAP_WORDS, hits)))
        assert plain_at_once(doc, item) == plain(doc, item)
        assert got <= plain(doc, item)
        # With a change and a replaced word, seeds are promised in windows of 13 words.
        if len(item) >= 13:
            assert got == plain(doc, item), (item, doc)
        seen[got] += 1
    assert min(seen) > 10
