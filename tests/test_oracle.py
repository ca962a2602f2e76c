"""Every registered query against its DuckDB oracle SQL on the small tables.

Row count, column names and an order-insensitive hash of rounded values must
agree (the same comparison the driver makes at sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as E
from quarry.sources.qa_model import TABLES
from tools.oracle_check import canon

from .conftest import SF_SMALL

QUERIES = E.queries()
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_is_registered_with_names():
    assert set(SQL) <= set(QUERIES)
    assert len([n for n in QUERIES if n not in SQL and not n.startswith("op") and n != "pipeline"]) == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = df.columns
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(cols) == sorted(dcols)
    assert len(srows) == len(drows)
    assert canon(srows, cols) == canon(drows, dcols)
