import pytest
from oracle import agree

from corpusmill.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    f = registry.QUERIES[name]
    if name in registry.ORACLES:
        agree(spark, sf, f, registry.ORACLES[name])
    else:
        assert f(spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
