"""Every registered query against its SQL on the small tables."""

import pytest

from tessella.suite import load
from tessella.suite.compare import compare, duck
from tessella.suite.registry import ORACLE, QUERIES
from tests.conftest import SF

load()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    good, note = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF)
    spark.catalog.clearCache()
    assert good, note


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["image_id", "white", "total"]
