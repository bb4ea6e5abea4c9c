"""Every query against its SQL at the small scales."""

import pytest
from oracle import compare
from sonarlake.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        ours, theirs = compare(df, ORACLES[name], SF)
        assert ours == theirs
    else:
        assert df.count() >= 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
