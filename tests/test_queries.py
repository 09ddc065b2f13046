"""Every registered query against its SQL; those without SQL run and keep their columns."""

import pytest
from compare import differences

from kerbline.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, medium, name):
    assert not differences(registry.queries()[name](spark, medium), registry.oracle_sql()[name], medium)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, small, name):
    found = registry.queries()[name](spark, small)
    assert found.columns and found.count() >= 0
