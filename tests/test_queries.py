"""Every registered query over the news model against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from newsgraph import registry
from tools_verify import TABLES, frame

@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    got = frame(registry.QUERIES[name](spark, sf).toPandas())
    if name in registry.ORACLES:
        want = frame(con.sql(registry.ORACLES[name]).df())
        assert list(got.columns) == list(want.columns)
        assert got.equals(want)
    else:
        assert len(got)


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
