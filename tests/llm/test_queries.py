"""Registered queries against SQL, and the rest of the library without the subpackage."""

import pytest

from tessella.llm.queries import ORACLE, QUERIES
from tessella.suite.compare import compare, duck
from tests.conftest import SF


@pytest.mark.parametrize("name", list(ORACLE))
def test_sql(spark, name):
    good, note = compare(spark, duck(SF), name, QUERIES[name], ORACLE[name], SF)
    assert good, note


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_entry_lists_them():
    import __spark_entry__ as entry

    assert {*QUERIES, "pipeline"} <= set(entry.queries())
