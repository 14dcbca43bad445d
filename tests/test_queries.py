"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest
from conftest import SF

from logquarry.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(row[c] for c in columns) for row in df.collect()), key=repr)
    assert name in ORACLES
    result = duck.execute(ORACLES[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    expected = sorted((tuple(row[found.index(c)] for c in columns) for row in result.fetchall()), key=repr)
    assert got == expected
