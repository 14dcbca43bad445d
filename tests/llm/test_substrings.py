import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from corpora import documents, odd_rows  # noqa: F401
from logquarry.llm.substrings import _GEAR, NEIGHBOURS, chunks, cut_words, drop_passages, gear_hashes, verified_passages


@given(st.binary(min_size=1, max_size=80))
def test_gear_hash_is_the_rolling_one(data):
    h, expected = 0, []
    for b in data:
        h = ((h << 1) + int(_GEAR[b])) & 0xFFFF
        expected.append(h)
    assert gear_hashes(np.frombuffer(data, np.uint8)).tolist() == expected


def prose(rng, n):
    return ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(n)]


@given(st.integers(0, 10**6), st.integers(0, 40), st.integers(0, 40))
def test_cuts_resist_shifts(seed, left, right):
    rng = random.Random(seed)
    passage, a, b = prose(rng, 80), prose(rng, left), prose(rng, right)
    found = []
    for before in (a, b):
        digest, first, many = chunks(" ".join([*before, *passage]))
        assert many.sum() == len(before) + 80 and (first[1:] == first[:-1] + many[:-1]).all()
        # From the first chunk that starts 16 bytes and a cut inside the passage.
        found.append([d for d, f in zip(digest.tolist(), first.tolist(), strict=True) if f >= len(before) + 40])
    assert found[0] == found[1]


def corpus():
    rng = random.Random(8)
    passages = [prose(rng, n) for n in (55, 60, 70, 90, 120) for _ in range(12)]
    docs, planted, text_of = [], [], {}
    line = prose(rng, 12)
    for i in range(400):
        text_of[i] = prose(rng, rng.randint(20, 150)) + (line if i % 5 == 0 else [])
    for passage in passages:
        holders = rng.sample(range(400), 3)
        for h in holders:
            at = rng.randint(0, len(text_of[h]))
            text_of[h] = text_of[h][:at] + passage + text_of[h][at:]
        planted += sorted(holders)[1:]
    docs = [(i, " \n".join(w)) for i, w in text_of.items()]
    clean = set(range(400)) - {h for h in planted}
    return docs, set(planted), clean, line


@given(st.lists(st.integers(0, 2**16 - 1), max_size=60))
def test_cuts_by_definition(hashes):
    """Low hashes, the least of a neighbourhood without a low one, and the last word."""
    expected = []
    for i, h in enumerate(hashes):
        around = hashes[max(0, i - NEIGHBOURS) : i + NEIGHBOURS + 1]
        expected.append(h < 2**14 or i == len(hashes) - 1 or (min(around) >= 2**14 and h == min(around)))
    assert cut_words(np.array(hashes, np.uint16)).tolist() == expected


def test_loops_are_cut(documents):
    """Text of a few repeated words has cuts, wherever its hashes lie."""
    rng = random.Random(1)
    rows, expected = [], set()
    for period in (1, 2, 3, 5, 8):
        for _ in range(12):
            loop = prose(rng, period) * (120 // period)
            i = len(rows)
            rows += [(i, " ".join(prose(rng, 30) + loop + prose(rng, 30))), (i + 1, " ".join(prose(rng, 17) + loop + prose(rng, 9)))]
            expected.add(i + 1)
    assert {r.doc_id for r in verified_passages(documents(rows)).collect()} == expected


def plain(rows, min_words=30):
    """The passages by the definition: the smallest holder of every chunk, then the words around it."""
    own = {i: t.encode().split() for i, t in rows}
    first, places = {}, {}
    for i in sorted(own):
        for d, at in zip(*(x.tolist() for x in chunks(b" ".join(own[i]).decode(), min_words)[:2]), strict=True):
            first.setdefault(d, (i, at))
            places.setdefault(i, {}).setdefault(d, at)
    out = []
    for i, found in places.items():
        spans = set()
        for d, at in found.items():
            holder, there = first[d]
            if holder < i:
                a, b, low, high = own[i], own[holder], at, at
                assert a[at : at + min_words] == b[there : there + min_words]
                while low and there - at + low and a[low - 1] == b[low - 1 + there - at]:
                    low -= 1
                while high < len(a) and high + there - at < len(b) and a[high] == b[high + there - at]:
                    high += 1
                spans.add((low, -high, holder))
        reached = 0
        for low, high, holder in sorted(spans):
            if -high > reached:
                out.append((i, low, -high - low, holder))
                reached = -high
    return sorted(out)


def test_against_brute_force(documents):
    docs, *_ = corpus()
    # Copies with changed words, whole copies and stretches of one word.
    rng = random.Random(4)
    for i in range(400, 520):
        text = rng.choice(docs[:400])[1].split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            text[rng.randrange(len(text))] = "changed"
        docs.append((i, " ".join(text + ["loop"] * rng.choice([0, 40, 90]))))
    for least in (30, 12):
        got = [tuple(r) for r in verified_passages(documents(docs), min_words=least).collect()]
        assert sorted(got) == plain(docs, least)


def test_a_copy_is_found_among_holders_of_its_parts(documents):
    words = prose(random.Random(12), 200)
    rows = [(i, " ".join(words[at : at + 20])) for i, at in enumerate(range(0, 200, 4))]
    rows += [(900, " ".join(words)), (901, " ".join(words))]
    assert [tuple(r) for r in verified_passages(documents(rows)).collect()] == [(901, 0, 200, 900)]


def test_odd_rows(documents, odd_rows):
    rng = random.Random(9)
    passage = " ".join(prose(rng, 80))
    rows = [*odd_rows, (20, passage), (21, "x " + passage), (21, "x " + passage), (22, "\n\t" + passage + " end\n"), (None, passage)]
    got = verified_passages(documents(rows)).collect()
    assert {r.doc_id for r in got} == {21, 22} and len(got) == 2
    kept = drop_passages(documents(rows))
    assert kept.columns == documents(rows).columns and kept.dtypes == documents(rows).dtypes
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(texts) == len(rows)
    assert sum(t == passage for _, t in texts) == 2
    spans = {r.doc_id: r for r in got}
    left = dict(texts)[22]
    assert left.startswith("\n\t") and left.endswith("\n") and len(left.split()) == 81 - spans[22].n_words
    unchanged = {(i, t) for i, t in rows if i not in (21, 22)}
    assert {x for x in texts if x[0] not in (21, 22)} == unchanged
    assert verified_passages(documents([])).collect() == [] and drop_passages(documents([])).collect() == []


def test_clashing_names(spark):
    words = " ".join(prose(random.Random(3), 80))
    names = ["_spans", "_owner", "a.b", "doc", "holder", "digest", "own"]
    rows = spark.createDataFrame([(1, words, *names), (2, words + " end", *names), (2, "short", *names)], ["doc_id", "text", *names])
    kept = drop_passages(rows)
    assert kept.columns == rows.columns
    assert sorted(tuple(r) for r in kept.collect()) == sorted([(1, words, *names), (2, "end", *names), (2, "", *names)])
