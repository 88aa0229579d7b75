"""Every registered query vs its DuckDB oracle (the driver's correctness gate), at sf0.001."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from tools.oracle_check import duck, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
ORACLE = E.oracle_sql()
QUERIES = E.queries()


def test_oracle_keys_registered():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "relapse_risk_score" in df.columns


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, con, key):
    sdf = QUERIES[key](spark, SF)
    s_cols, s_rows = sdf.columns, [tuple(r) for r in sdf.collect()]
    res = con.execute(ORACLE[key])
    d_cols, d_rows = [d[0] for d in res.description], res.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert rows_of(s_cols, s_rows) == rows_of(d_cols, d_rows)
