"""Every registered query against its SQL."""

import os

import pytest

import __spark_entry__ as driver
from workloads.check import connect, differences
from workloads.oracles import all_oracles
from workloads.queries import all_queries

SF_DIR = f"/root/testdata/{os.environ.get('TEST_SF', 'sf0.01')}"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_oracles())
    assert set(all_queries()) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    assert differences(driver.queries()[name](spark, SF_DIR), duck, driver.oracle_sql()[name]) == []


def test_entry(spark):
    found = driver.entry(spark)
    assert found.count() > 0
    assert found.columns[-1] == "split"
