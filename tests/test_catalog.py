"""Every registered query runs; those with SQL equal DuckDB's answer."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations"]
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def _rows(frame, columns):
    values = frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()
    return sorted(map(repr, values))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = duck.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert [str(got[c].dtype) for c in columns] == [str(want[c].dtype) for c in columns]
    assert _rows(got, columns) == _rows(want, columns)


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
