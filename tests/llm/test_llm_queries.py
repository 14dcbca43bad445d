"""Every registered query of the subpackage against its SQL twin, and the pipeline against brute force."""

import duckdb
import pytest

import corpus_pipeline
from corpora import documents, odd_rows  # noqa: F401
from logquarry.llm.queries import ORACLES, QUERIES

TABLES = "documents pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(row[c] for c in columns) for row in df.collect()), key=repr)
    result = duck.execute(ORACLES[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    expected = sorted((tuple(row[found.index(c)] for c in columns) for row in result.fetchall()), key=repr)
    assert got == expected


def test_pipeline_against_brute_force(spark, sf, tmp_path, monkeypatch):
    import public_tokenizers
    import test_linedup
    from test_decontaminate import words
    from test_overlaps import plain_at_once
    from test_similar import groups
    from logquarry.llm.linedup import within_one_edit
    from test_packing import check
    from tokenizers import Tokenizer

    from logquarry.llm.queries import table
    from logquarry.llm.toxicity import toxicity

    docs = table(spark, sf, "documents")
    steps = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        assert i == 4 or docs.dtypes == before.dtypes
        steps.append(docs.collect())
    # Stage 1 keeps what the operator's scores keep; their making is tested with the operator.
    scores = toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")).collect()
    assert {r.doc_id for r in steps[0]} == {r.doc_id for r in scores if r.score < 0.7}
    # The brute force over all pairs of lines, with the edit distance that is tested against its definition.
    monkeypatch.setattr(test_linedup, "distance", lambda a, b: 1 if within_one_edit(a, b) else 2)
    expected = test_linedup.plain([(r.doc_id, r.text) for r in steps[0]])
    assert {r.doc_id: r.text for r in steps[1]} == {i: t for i, (t, _) in expected.items()}
    assert all(r.n_chars == len(r.text) for r in steps[1])
    rows = sorted(steps[1], key=lambda r: r.doc_id)
    # Exact Jaccard similarity of all pairs, then every window of every item at every place.
    roots = groups([r.text for r in rows])
    assert {r.doc_id for r in steps[2]} == {rows[i].doc_id for i in set(roots)}
    bench = [words(r.text) for r in table(spark, sf, "benchmark").collect()]
    leaked = {r.doc_id for r in steps[2] if any(plain_at_once(words(r.text), item) for item in bench)}
    assert leaked and {r.doc_id for r in steps[3]} == {r.doc_id for r in steps[2]} - leaked
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check(steps[4], [(r.doc_id, r.text) for r in steps[3]], whole, 1024, 1024, 1024**2)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).drop("ids", "sequence_id", "offset").collect())) == sorted(
        (r.doc_id, r.piece, r.start, r.length) for r in steps[4]
    )


def test_pipeline_on_odd_rows_and_empty_tables(spark, documents, odd_rows, tmp_path, monkeypatch):
    """Nulls, empty and long texts, ties and repeated rows through all stages, and tables without rows."""
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, 0), (7, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "no such passage of words in any text here"), (2, None), (None, "")], "item_id long, text string")
    for number, (rows, given) in enumerate((([*odd_rows, (20, "only\nlines\n"), (21, "a b")], (labels, bench)), ([], (labels, bench)), (odd_rows, (labels.limit(0), bench.limit(0))))):
        folder = tmp_path / str(number)
        for name, df in (("documents", documents(rows)), ("labels", given[0]), ("benchmark", given[1])):
            df.write.parquet(f"{folder}/{name}.parquet")
        out = corpus_pipeline.run(spark, str(folder)).collect()
        if not rows:
            assert out == []
            continue
        kept = {r.doc_id for r in out}
        # One of the equal texts, one of the wordless ones, the long one, and rows without an id.
        assert {None, 4, 7, 8, -10} <= kept and not {6, 9} & kept and len({1, 2, 3} & kept) <= 1
        assert all(r.length <= 1024 for r in out)
