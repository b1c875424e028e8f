import pytest

from spoor.plans import codecs, fleet, framed, queries, registry, streams
from tests.oracle import same


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_same_rows_as_sql(spark, sf, name):
    assert same(spark, sf, registry.QUERIES[name], registry.ORACLE_SQL[name]) > 0
