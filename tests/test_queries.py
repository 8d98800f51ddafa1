"""Every registered query against its SQL, at the smallest scale."""

import compare
import pytest

import __spark_entry__ as entry
from massq.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.oracle(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.SQL:
        assert compare.differences(df, con, registry.SQL[name]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
