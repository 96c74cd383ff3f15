"""Every query of the library against its SQL at the smallest scale."""

import pytest

from railside import registry
from tests.oracle import SMALL, differences

import __spark_entry__  # noqa: F401  registers the queries

NAMES = sorted(registry.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    result = registry.QUERIES[name](spark, SMALL)
    if name in registry.ORACLES:
        assert differences(result, SMALL, registry.ORACLES[name]) == []
    else:
        assert result.columns and result.count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
