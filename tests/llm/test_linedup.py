import random
import re

from hypothesis import given
from hypothesis import strategies as st

from corpora import documents, odd_rows  # noqa: F401
from logquarry.llm.linedup import dedup_lines, neighbourhood, within_one_edit


def words(line):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", line) if w]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain(rows):
    """Texts without the lines that an earlier line matches, and the number of lines removed."""
    earlier, out = [], {}
    for i, text in sorted(rows):
        kept, removed = [], 0
        for line in text.split("\n"):
            w = words(line)
            near = any(w == e or (min(len(w), len(e)) >= 5 and distance(w, e) <= 1) for e in earlier)
            if w:
                earlier.append(w)
            if w and near:
                removed += 1
            else:
                kept.append(line)
        out[i] = ("\n".join(kept), removed)
    return out


short = st.lists(st.sampled_from("abc"), max_size=7)


@given(short, short)
def test_within_one_edit(a, b):
    assert within_one_edit(a, b) == (distance(a, b) <= 1)


@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=9))
def test_neighbourhood(line):
    data = [w.encode() for w in line]
    own = neighbourhood(data)
    assert len(own) == len(line) + 1
    for i in range(len(line)):
        rest = data[:i] + data[i + 1 :]
        if rest:
            assert own[i + 1] == neighbourhood(rest)[0]


def test_against_brute_force(documents):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 8)):
            line = [rng.choice("a b c d".split()) for _ in range(rng.choice([0, 1, 4, 5, 6, 6, 7, 8]))]
            lines.append(rng.choice(["", " ", "\t"]) + " ".join(line) + rng.choice(["", "\r"]))
        rows.append((i, "\n".join(lines)))
    # A family that differs in one word, and a chain of single edits.
    base = "the page number x of the long report is".split()
    rows += [(100 + i, " ".join(base[:3] + [str(i)] + base[4:])) for i in range(30)]
    rows += [(200 + i, " ".join(f"w{j + (j < i)}" for j in range(9))) for i in range(9)]
    rng.shuffle(rows)
    got = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(documents(rows), removed_col="n_removed").collect()}
    assert got == plain(rows)


def test_odd_rows(documents, odd_rows):
    df = documents(odd_rows)
    out = dedup_lines(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == len(odd_rows)
    texts = {}
    for i, t in got:
        texts.setdefault(i, []).append(t)
    prose = dict(odd_rows)[5]
    assert sorted(texts[None], key=repr) == sorted([None, prose], key=repr)
    assert texts[1] == [None] and texts[2] == [""] and texts[3] == [" \t\n "]
    assert texts[5] == ["", ""] and texts[6] == [""] and texts[9] == [""]
    assert texts[4] == [dict(odd_rows)[4]] and texts[8] == [dict(odd_rows)[8]]


def test_repeated_rows_are_one_document(documents):
    got = dedup_lines(documents([(1, "a b\na b"), (1, "a b\na b"), (1, "c d")])).collect()
    assert sorted(r.text for r in got) == ["a b", "a b", "c d"]


def test_empty_table(documents):
    assert dedup_lines(documents([])).collect() == []
