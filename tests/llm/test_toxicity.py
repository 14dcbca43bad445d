import math
import random
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpora import documents, odd_rows  # noqa: F401
from logquarry.llm.toxicity import FtrlProximal, drop_toxic, features, toxicity, toxicity_model

BAD = ["nasty", "rotten", "vile"]


@pytest.fixture(scope="module")
def corpus(spark, documents):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(900):
        text = rng.choices(vocabulary, k=rng.randint(5, 60))
        toxic = int(i % 6 == 0)
        for _ in range(toxic * rng.randint(2, 4)):
            text.insert(rng.randint(0, len(text)), rng.choice(BAD))
        docs.append((i, " ".join(text)))
        labels.append((i, 1, toxic))
    odd = [(0, 1, None), (None, 1, 1), (10_000, 1, 1), (1, 1, 5)]
    return documents(docs), spark.createDataFrame(labels + odd, "doc_id long, quality int, toxic int"), dict(docs)


def test_features_are_word_pairs_with_gaps():
    found = [x for block in features("One, two THREE four five", 20) for x in block.tolist()]
    assert len(found) == 5 + 4 + 3 + 2
    assert found[:5] == [x for block in features("one two three four five", 20) for x in block.tolist()][:5]
    assert list(features(None, 20)) == [] and list(features(" .!", 20)) == []


@given(st.lists(st.tuples(st.sets(st.integers(0, 15), max_size=5), st.integers(0, 1)), max_size=30))
def test_learner_follows_the_published_update(examples):
    """Against the update written coordinate by coordinate."""
    import numpy as np

    alpha, beta, l1, l2 = 0.5, 1.0, 0.3, 0.1
    learner = FtrlProximal(4, alpha, beta, l1, l2)
    z, n = [0.0] * 17, [0.0] * 17

    def weight(i):
        bound = 0.0 if i == 16 else l1
        if abs(z[i]) <= bound:
            return 0.0
        return -(z[i] - math.copysign(bound, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for index, label in examples:
        own = [*sorted(index), 16]
        ws = [weight(i) for i in own]
        g = 1 / (1 + math.exp(-sum(ws))) - label
        for i, w in zip(own, ws, strict=True):
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
        learner.learn(np.array(sorted(index), np.int32), label)
    assert learner.weights(np.arange(17)) == pytest.approx([weight(i) for i in range(17)], abs=1e-9)


def test_held_out_rows_are_told_apart(corpus):
    docs, labels, texts = corpus
    rows = toxicity(docs, labels).collect()
    assert len(rows) == len(texts)
    hits = misses = wrong = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        toxic = any(w in texts[r.doc_id].split() for w in BAD)
        if r.held_out:
            hits += toxic and r.predicted
            misses += toxic and not r.predicted
            wrong += r.predicted and not toxic
    assert hits > 30 and misses <= 0.1 * hits and wrong <= 2
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in rows if not r.predicted}


def test_labels_of_held_out_rows_are_not_used(spark, corpus):
    docs, labels, _ = corpus
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - toxic, toxic) as toxic")
    a, b = toxicity_model(docs, labels), toxicity_model(docs, flipped)
    assert a.bias == b.bias and (a.index == b.index).all() and (a.weight == b.weight).all()
    few = toxicity_model(docs, labels, max_rows=10)
    assert len(few.index) < len(a.index)


def test_a_sample_keeps_the_shares_of_the_labels(corpus):
    """With fewer rows than there are, clean documents are still told from toxic ones."""
    docs, labels, texts = corpus
    rows = toxicity(docs, labels, max_rows=300).collect()
    clean = [r for r in rows if not any(w in texts[r.doc_id].split() for w in BAD)]
    assert sum(r.predicted for r in clean) <= 2


def test_odd_rows(spark, documents, odd_rows, corpus):
    _, labels, _ = corpus
    got = toxicity(documents(odd_rows), labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], labels.schema)
    assert {(r.score, r.predicted) for r in toxicity(documents(odd_rows), none).collect()} == {(0.5, 0)}
    assert toxicity(documents([]), labels).collect() == []
    assert drop_toxic(documents([]), none).collect() == []
