"""Every registered query against its SQL text, on the smallest tables."""

import pytest
from compare import connect, difference

from cohortloom.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE:
        assert difference(df, con, ORACLE[name]) is None  # an empty result is a difference
    else:
        assert df.count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["o_orderkey", "n_prior", "days_since_last", "last_prior_value", "no_history"]
