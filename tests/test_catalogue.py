"""Every query gives the rows of its SQL."""

import pytest

import __spark_entry__
from tests.conftest import SF, same_rows
from tidewater.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_rows_are_those_of_the_sql(spark, duck, name):
    same_rows(catalogue.queries()[name](spark, SF), duck, catalogue.oracle_sql()[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
