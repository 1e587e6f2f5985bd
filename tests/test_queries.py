"""Every registered query of the estate engine against its SQL on the driver's tables."""

import pytest

from loomgraph.plans import estate_queries
from tests.conftest import same_rows

QUERIES, ORACLES = estate_queries.queries(), estate_queries.oracle_sql()


def test_each_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(name, spark, sf, duck):
    same_rows(QUERIES[name](spark, sf), duck, ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["callee_repo", "fan_in"]
    assert set(QUERIES) <= set(__spark_entry__.queries())
