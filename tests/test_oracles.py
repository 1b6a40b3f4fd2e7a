"""Every registered query against its SQL in DuckDB, whole results."""

import compare
import pytest

from credence import plans

QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return compare.connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, small, name):
    assert compare.differences(spark, con, QUERIES[name], ORACLES[name], small) == []


def test_every_query_has_sql_but_for_fits_and_files():
    assert set(QUERIES) - set(ORACLES) == {"c27_probe_accuracy", "c29_probe_split"}


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["split", "block", "part", "metric", "value"] and df.count() > 0
