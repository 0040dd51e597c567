"""The operators' queries against their DuckDB statements."""

import pytest

from docrevise.llm import queries as Q
from tests.oracle import duck, rows_of


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    df, rel = Q.QUERIES[name](spark, sf), duck(sf).sql(Q.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())
