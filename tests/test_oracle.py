"""Every registered query with an oracle SQL equals DuckDB on the same parquet tables."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import compare, duck

SQLS = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con(smoke_dir):
    return duck(smoke_dir)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_matches_oracle(spark, smoke_dir, con, name):
    sp = QUERIES[name](spark, smoke_dir).toPandas()
    ora = con.execute(SQLS[name]).fetchdf()
    n_sp, n_or, cols_ok, _exact, tol = compare(sp, ora)
    assert cols_ok, (sorted(sp.columns), sorted(ora.columns))
    assert n_sp == n_or
    assert tol


def test_every_query_has_a_builder():
    assert set(SQLS) <= set(QUERIES)
    assert len(QUERIES) >= 50


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 15
    assert df.columns == ["region", "city", "avg_wind_speed_kmh", "wind_speed_95th_kmh", "max_wind_speed_kmh",
                          "wind_speed_std_kmh", "avg_wind_direction_deg"]
