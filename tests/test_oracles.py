"""Every query against its SQL over the smallest tables; queries without SQL give rows with a stable schema."""

import pytest
from oracle import DATA, connect, same

from quire.plans import registry

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    if name in registry.ORACLES:
        same(df, duck, registry.ORACLES[name])
    else:
        assert df.schema == registry.QUERIES[name](spark, FOLDER).schema
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
