import pytest

from spanforge.plans.catalog import ORACLES, QUERIES
from tests.conftest import rows_of


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, sql, name):
    got = rows_of(QUERIES[name](spark, sf).toPandas())
    if name in ORACLES:
        assert got == sql(ORACLES[name])
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
