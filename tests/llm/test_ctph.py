import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from corpora import documents, odd_rows  # noqa: F401
from logquarry.llm.ctph import _common, edit_report, edited, fingerprint, fingerprint_column, fingerprints, likeness, likeness_column


@given(st.text("abc", max_size=30), st.text("abc", max_size=30))
def test_longest_common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[-1], last[j + 1]))
    assert _common(a, b) == row[-1]


@given(st.text(max_size=300), st.text(max_size=300))
def test_likeness_is_symmetric_and_bounded(a, b):
    x, y = fingerprint(a), fingerprint(b)
    assert likeness(x, x) == 1.0 and likeness(x, y) == likeness(y, x) and 0 <= likeness(x, y) <= 1
    bits, *signatures = x.split(":")
    assert len(signatures) == 3 and all(len(s) <= 64 for s in signatures) and int(bits) >= 0


def prose(rng, n):
    return " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(n))


def test_signatures_follow_local_edits():
    rng = random.Random(11)
    for n in (10, 50, 300, 3000, 60_000):
        text, other = prose(rng, n), prose(rng, n)
        at = len(text) // 2
        assert likeness(fingerprint(text), fingerprint(text[:at] + "inserted words" + text[at:])) > 0.6
        assert likeness(fingerprint(text), fingerprint(edited(text, other))) > 0.3
        assert likeness(fingerprint(text), fingerprint(other)) < 0.35


def plain(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = []
    for (i, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        a, b, c = fingerprint(text), fingerprint(new), fingerprint(following)
        out.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c)))
    return sorted(out)


def test_neighbours_across_partitions(spark, documents):
    rng = random.Random(12)
    rows = [(i * 3 - 50, prose(rng, rng.randint(0, 40)) + rng.choice(["", "é𝄞"])) for i in range(150)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "8", "90"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert sorted(map(tuple, edit_report(documents(rows)).collect())) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_odd_rows(documents, odd_rows):
    got = edit_report(documents(odd_rows)).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((i for i, _ in odd_rows), key=repr)
    assert {r.n_chars for r in got if r.doc_id in (1, 2)} == {0}
    by_text = {}
    for (i, text) in odd_rows:
        for r in got:
            if r.doc_id == i and i not in (None,):
                by_text.setdefault(text or "", set()).add(r.fingerprint)
    assert all(len(prints) == 1 for prints in by_text.values())
    assert edit_report(documents([])).collect() == []
    alone = edit_report(documents([(3, "abcd")])).collect()
    assert [(r.n_chars, r.near_next, r.edited_sha256) for r in alone] == [(4, 1.0, hashlib.sha256(b"abab").hexdigest())]


def test_columns(documents, odd_rows):
    df = fingerprints(documents(odd_rows), out_col="print")
    got = df.select("text", "print", likeness_column(df["print"], fingerprint_column(df["text"])).alias("same")).collect()
    assert all(r["print"] == fingerprint(r.text) and r.same == 1.0 for r in got)
