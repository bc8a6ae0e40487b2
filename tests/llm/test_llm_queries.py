"""The registered llm queries against their DuckDB equivalents."""

import duckdb
import pytest

from tests.test_queries import TABLES, rows_of
from tidegrid.llm import queries


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(name, spark, sf_dir, con):
    got = queries.QUERIES[name](spark, sf_dir)
    rows, want = got.collect(), con.sql(queries.ORACLE_SQL[name])
    assert rows_of(got.columns, rows) == rows_of(want.columns, want.fetchall())


def test_registered_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
