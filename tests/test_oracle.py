"""Every registered query against its DuckDB statement on sf0.001
(row count, column names, order-insensitive values); queries without SQL
must at least run."""

import pytest

from docrevise.plans import catalog
from tests.oracle import compare, duck

NAMES = sorted(catalog.REGISTRY)


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf, con, name):
    r = compare(spark, name, sf, con)
    if r.get("oracle", 1) is None:
        assert r["spark_rows"] >= 0
        return
    assert r["cols_match"], r
    assert r["count_match"], r
    assert r["values_match"], r
    assert r["types_match"], r


def test_entry_runs(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["doc_id", "chunk_no", "score", "rank"]
    assert df.count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
