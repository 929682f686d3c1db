"""Every query of the suite against its SQL in DuckDB."""

import duckdb
import pytest

from weftline import suite

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(suite.oracle_sql()))
def test_oracle(spark, con, name):
    rel = con.sql(suite.oracle_sql()[name])
    got = suite.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(rel.columns)
    assert ordered(tuple(r[c] for c in rel.columns) for r in got.collect()) == ordered(rel.fetchall())
