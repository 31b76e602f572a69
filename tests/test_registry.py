"""Every registered query of the library against its oracle SQL."""

import oracle
import pytest

from tessera.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    return oracle.duck(sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, con, sf, name):
    assert name in registry.SQL
    assert oracle.compare(spark, con, name, sf) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
