"""Every registered query against its DuckDB oracle at sf0.01 (the driver's correctness gate);
queries without an oracle must at least run."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck_connect, spark_rows

SF = "/root/testdata/sf0.01"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    if name not in ORACLES:
        cols, rows = spark_rows(QUERIES[name](spark, SF))
        assert cols
        return
    r = compare(spark, con, SF, name, QUERIES[name], ORACLES[name])
    assert r["ok"], r


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["conv_id", "text"]
    assert df.count() > 0
