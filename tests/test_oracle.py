"""Spark vs DuckDB parity on the small fixture for the whole registry (tools/check_oracle.py checks other sizes)."""

import duckdb
import pytest

from conftest import SF_SMALL
from feedspark.plans.queries import oracle_sql, queries
from tools.check_oracle import TABLES, digest

NAMES = sorted(oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_parity(spark, con, name):
    df = queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_every_query_has_a_callable_and_most_an_oracle():
    q, o = queries(), oracle_sql()
    assert set(o) <= set(q)
    assert len(o) >= len(q) - 2
