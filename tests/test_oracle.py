"""Every query with an oracle matches DuckDB on sf0.001 (row count, columns, values)."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import duck, frame_hash

SF = "/root/testdata/sf0.001"
SQL = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["bin", "bin_label", "n_rows", "n_target", "target_rate"]
    assert len(rows) == 4


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert frame_hash(sdf.columns, srows)[0] == frame_hash(dcols, drows)[0]
