"""Operators that return all columns keep those whose names they use themselves, and names with dots."""

import pytest
from corpora import CLASHES

from logquarry.llm.ctph import fingerprints
from logquarry.llm.decontaminate import drop_contaminated
from logquarry.llm.linedup import dedup_lines
from logquarry.llm.similar import drop_similar
from logquarry.llm.simhash import drop_near_copies
from logquarry.llm.substrings import drop_passages
from logquarry.llm.toxicity import drop_toxic

NAMES = [*CLASHES, *"_toxicity _spans _owner _copy_id _leaked_id _held _piece _bits _id _text _label touched gone text_ a.b n`t row others d b".split(), "with space"]
NAMES = [n for n in dict.fromkeys(NAMES) if n.lower() not in ("doc_id", "text")]


@pytest.fixture(scope="module")
def wide(spark):
    prose = " ".join(f"word{i}" for i in range(60))
    rows = [(1, prose + "\nshared line of five words\nend"), (2, prose), (3, "shared line of five words\nother"), (4, None), (None, "x")]
    return spark.createDataFrame([(*r, *[f"{r[0]} {n}" for n in NAMES]) for r in rows], ["doc_id", "text", *NAMES])


def bench(spark):
    return spark.createDataFrame([(1, "no such passage in any of the documents at all")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")


@pytest.mark.parametrize(
    "operator",
    [
        lambda spark, df: drop_toxic(df, labels(spark)),
        lambda spark, df: dedup_lines(df),
        lambda spark, df: drop_similar(df),
        lambda spark, df: drop_near_copies(df),
        lambda spark, df: drop_contaminated(df, bench(spark)),
        lambda spark, df: drop_passages(df),
    ],
    ids="toxic lines similar simhash contaminated passages".split(),
)
def test_all_columns_stay(spark, wide, operator):
    out = operator(spark, wide)
    assert out.columns == wide.columns and out.dtypes == wide.dtypes
    rows = out.collect()
    assert rows
    for r in rows:
        assert list(r)[2:] == [f"{r[0]} {n}" for n in NAMES]
    assert operator(spark, wide.limit(0)).collect() == []


def test_added_columns(spark, wide):
    assert fingerprints(wide, out_col="a print").columns == [*wide.columns, "a print"]
    # A column of the name gives its place.
    assert fingerprints(wide).columns == wide.columns
    assert dedup_lines(wide, removed_col="lines gone").columns == [*wide.columns, "lines gone"]
    with pytest.raises(ValueError):
        dedup_lines(wide, removed_col="gone")
