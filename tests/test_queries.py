import pytest

from tests.conftest import SF, same_rows
from tessera.jobs.state_queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    assert same_rows(QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["m", "i", "j", "q", "n"]
    assert set(QUERIES) <= set(__spark_entry__.queries())
