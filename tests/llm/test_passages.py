import random

from corpora import documents  # noqa: F401
from logquarry.llm.substrings import chunks, drop_passages, verified_passages
from test_substrings import corpus, prose


def test_runs_stitched_from_unrelated_documents_are_no_passages(documents):
    words = prose(random.Random(12), 200)
    # Every earlier document holds 20 words, in which the chunks end as in the whole.
    rows = [(i, " ".join(words[at : at + 20])) for i, at in enumerate(range(0, 200, 4))]
    rows.append((900, " ".join(words)))
    assert verified_passages(documents(rows)).collect() == []
    assert {r.doc_id: r.text for r in drop_passages(documents(rows)).collect()} == dict(rows)


def test_passages_are_held_whole_and_extended_to_both_ends(documents):
    docs, planted, clean, _ = corpus()
    rows = verified_passages(documents(docs)).collect()
    words = {i: t.split() for i, t in docs}
    for r in rows:
        own, holder = words[r.doc_id], words[r.holder]
        end = r.first_word + r.n_words
        places = [i for i in range(len(holder)) if holder[i : i + r.n_words] == own[r.first_word : end]]
        assert r.n_words >= 30 and r.holder < r.doc_id and places
        assert all(not i or not r.first_word or holder[i - 1] != own[r.first_word - 1] for i in places)
        assert all(holder[i + r.n_words : i + r.n_words + 1] != own[end : end + 1] or end == len(own) for i in places)
    found = {r.doc_id for r in rows}
    assert len(planted - found) <= 0.03 * len(planted) and not found & clean
    assert verified_passages(documents([])).collect() == [] and len(chunks("")[0]) == 0
