"""Every registered query against its SQL on the smallest test folder."""

import compare
import pytest
from conftest import SMALL

import __spark_entry__ as entry_module
from merchlake.registry import QUERIES
from oracle.sql import ORACLES


@pytest.fixture(scope="module")
def db():
    return compare.connect(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_equals_sql(spark, db, key):
    assert compare.differences(QUERIES[key](spark, SMALL), db, ORACLES[key]) == []


def test_entry(spark):
    assert entry_module.entry(spark).count() == 10
