import pytest

from spoor.llm import registry
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, name):
    assert same(spark, sf, registry.QUERIES[name], registry.ORACLE_SQL[name]) > 0
