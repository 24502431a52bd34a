"""Queries with an SQL form agree with it on sf0.01."""

import pytest

from riskframe.llm import queries
from tools.oracle_check import duck, frame_hash

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    out = queries.QUERIES[name](spark, SF)
    res = duck(SF).execute(queries.ORACLES[name])
    columns = [d[0] for d in res.description]
    rows, want = [tuple(r) for r in out.collect()], res.fetchall()
    assert sorted(out.columns) == sorted(columns) and len(rows) == len(want)
    assert frame_hash(out.columns, rows)[0] == frame_hash(columns, want)[0]
