"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import duckdb
import pandas as pd
import pytest

from parlance.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(frame):
    cols = sorted(frame.columns)
    return sorted(repr(tuple(None if v is None or v is pd.NA or v != v else str(v) for v in r)) for r in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got, want = QUERIES[name](spark, small).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, small, name):
    """These have tests of their own rules elsewhere; here they run as the driver runs them."""
    rows = QUERIES[name](spark, small)
    assert rows.columns and rows.count() > 0 and len(rows.take(3)) > 0
