"""The queries that SQL expresses against their SQL; entry points."""

import pytest
from compare import differences

from kerbline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, small, name):
    assert not differences(queries.queries()[name](spark, small), queries.oracle_sql()[name], small)


def test_entry_registers_all():
    import __spark_entry__ as entry

    assert {f"op{i}_" for i in range(1, 14)} == {x.split("_")[0] + "_" for x in entry.queries() if x.startswith("op")}
    assert "pipeline" in entry.queries()
