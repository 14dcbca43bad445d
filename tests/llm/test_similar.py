import random

from corpora import documents, odd_rows  # noqa: F401
from logquarry.llm.similar import drop_similar, similar_components


def plain_set(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def groups(texts, least=0.8):
    """The smallest index that links lead to, for each text."""
    sets, root = [plain_set(t) for t in texts], list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if plain_similarity(a, sets[j]) >= least:
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(texts))]


def planted(rng, pairs=150):
    """Texts, and pairs of their indices at similarity 0.8 to 0.95; further pairs are below that."""
    texts, near = [], []
    for _ in range(pairs):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 400))]
        copy = list(words)
        for at in rng.sample(range(len(words)), max(1, len(words) * rng.choice([1, 2, 3, 5]) // 120)):
            copy[at] = f"x{rng.randrange(3000)}"
        likeness = plain_similarity(plain_set(" ".join(words)), plain_set(" ".join(copy)))
        if 0.8 <= likeness <= 0.95:
            near.append((len(texts), len(texts) + 1))
        texts += [" ".join(words), " ".join(copy)]
    return texts, near


def test_planted_near_copies(documents):
    texts, near = planted(random.Random(4))
    # A family in which neighbours are near and the ends are not.
    words = [f"v{i}" for i in range(200)]
    for i in range(0, 60, 2):
        texts.append(" ".join(f"y{j}" if j < i else w for j, w in enumerate(words)))
    assert len(near) > 50
    got = {r.doc_id: r.component_id for r in similar_components(documents(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == groups(texts)
    assert all(got[a] == got[b] for a, b in near)


def test_pipeline_stage_drops_planted_near_copies(spark, sf, documents):
    import corpus_pipeline

    texts, near = planted(random.Random(6), 60)
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, documents(list(enumerate(texts))), sf).collect()}
    assert len(near) > 20 and not kept & {b for _, b in near}
    assert kept == set(groups(texts))


def test_odd_rows(documents, odd_rows):
    got = sorted(map(tuple, similar_components(documents(odd_rows)).collect()), key=repr)
    roots = groups([t for _, t in odd_rows])
    expected = []
    for (i, _), r in zip(odd_rows, roots, strict=True):
        ids = [j for (j, _), s in zip(odd_rows, roots, strict=True) if s == r and j is not None]
        expected.append((i, min(ids, default=None)))
    assert got == sorted(expected, key=repr)
    kept = drop_similar(documents(odd_rows))
    assert kept.columns == documents(odd_rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([None, None, 1, 4, 5, 5, 7, 8, -10], key=repr)
    assert drop_similar(documents([])).collect() == []
