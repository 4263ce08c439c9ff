"""Every registered query at the smallest scale, against its check SQL where there is one."""

import os

import pytest

import __spark_entry__ as entry
from oracle import DATA, compare, connect

SF_DIR = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    fn, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert fn(spark, SF_DIR).count() > 0
        return
    problem, _ = compare(spark, con, fn, sql, SF_DIR)
    assert problem is None
