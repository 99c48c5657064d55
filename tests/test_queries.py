"""Every registered query of the library against its SQL."""

import pytest
from oracle import compare, connect

from lodestone.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, con, name):
    assert compare(registry.QUERIES[name](spark, SF), con, registry.SQL[name]) == ""


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
