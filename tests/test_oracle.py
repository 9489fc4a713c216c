"""Every query with an SQL form gives the same rows as DuckDB on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as driver
from checks.compare import connect, difference

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not mounted")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", driver.oracle_sql())
def test_query_equals_sql(spark, con, name):
    assert difference(driver.queries()[name](spark, SF), con, driver.oracle_sql()[name]) is None


def test_every_sql_form_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
