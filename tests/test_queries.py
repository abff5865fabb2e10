"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from callscope.queries import catalog, oracle
from tests.compare import check

SF = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(oracle.oracle_sql()) == set(catalog.queries())


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, name):
    rows, verdict = check(spark, name, SF)
    assert verdict == "same"


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "user_id"
