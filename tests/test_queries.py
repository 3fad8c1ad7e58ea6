"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from pedon.plans import doses, fields, queries, rules

QUERIES, SQL = queries.queries() | rules.queries() | doses.queries() | fields.queries(), queries.oracle_sql() | rules.oracle_sql() | doses.oracle_sql() | fields.oracle_sql()
SF = "/root/testdata/sf0.001"


def _rows(df):
    cols = sorted(df.columns)
    tidy = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return cols, sorted(tuple(map(str, (tidy(v) for v in r))) for r in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    assert len(got) and _rows(got) == _rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["model_choice", "kriging"])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
