"""Every registered query of the engine against its SQL on the smallest tables."""

import pytest

from graphloom import queries as engine
from tests.oracle import connect, differs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query_equals_its_sql(spark, connection, name):
    assert name in engine.ORACLE_SQL, "no SQL"
    assert differs(spark, connection, engine.QUERIES[name], engine.ORACLE_SQL[name], SF) == ""


def test_entry_gives_rows(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["o_orderkey", "o_orderpriority", "priority_code"] and df.count() == 1500
